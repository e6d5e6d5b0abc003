"""Paths, seeds and clusters of the search as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def likeliest(paths: DataFrame, by: list[str], prob: str, ties: list[str]) -> DataFrame:
    """Of the paths with one range the likeliest; of equal ones the last by ``ties``. One partial aggregation, no sort."""
    others = [c for c in paths.columns if c not in by]
    best = F.max(F.struct(prob, *ties, *[c for c in others if c != prob and c not in ties])).alias("_b")
    return paths.groupBy(*by).agg(best).select(*by, *[F.col(f"_b.`{c}`").alias(c) for c in others])


def fresh_sources(kmers: DataFrame, paths: DataFrame, least: float) -> DataFrame:
    """k-mers (kmer, prob) that pass the threshold and have no path (kmer)."""
    used = paths.select(F.col("kmer").alias("_used")).distinct()
    return kmers.filter(F.col("prob") >= least).join(used, F.col("kmer") == F.col("_used"), "left_anti")


def earlier_seeds(seeds: DataFrame, reach: int) -> DataFrame:
    """(read_id, seed, prev, n): the latest earlier seed of a read that a seed can follow, and how many there are.

    ``seeds``: read_id, seed, r (place), e (event). A seed follows one that is ``de`` > 0 events before it if its place is
    0 to ``de`` and at least ``de`` div 12 further. Only seeds at most ``reach`` events apart are paired: set it to the
    longest read to lose none. Seeds meet in bins of place of that width, so a read's far places make no pairs.
    """
    a = seeds.select(F.col("read_id").alias("_read"), F.col("seed").alias("prev"), F.col("r").alias("r1"), F.col("e").alias("e1"), F.explode(F.array(F.floor(F.col("r") / reach), F.floor(F.col("r") / reach) + 1)).alias("_bin"))
    b = seeds.withColumn("_at", F.floor(F.col("r") / reach))
    dr, de = F.col("r") - F.col("r1"), F.col("e") - F.col("e1")
    pairs = b.join(a, (F.col("read_id") == F.col("_read")) & (F.col("_at") == F.col("_bin"))).filter((de > 0) & (de <= reach) & (dr >= 0) & (dr <= de) & (dr >= F.floor(de / 12)))
    return pairs.groupBy("read_id", "seed").agg(F.max_by("prev", F.struct(-de, F.col("prev"))).alias("prev"), F.count(F.lit(1)).alias("n"))


def top_two(clusters: DataFrame, by: str, length: str) -> DataFrame:
    """(by, n, top, second, mean) of cluster lengths. The second is the longest behind one of the longest; two partial aggregations, no list."""
    sizes = clusters.groupBy(by, length).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum(F.col("_c") * F.col(length))
    best = F.sort_array(F.collect_set(F.struct(F.col(length).alias("v"), F.col("_c").alias("c"))), asc=False)
    g = sizes.groupBy(by).agg(F.sum("_c").alias("n"), (total / F.sum("_c")).alias("mean"), best.alias("_s"))
    top, more = F.get("_s", 0), F.get("_s", 1)
    return g.select(by, "n", top["v"].alias("top"), F.when(top["c"] > 1, top["v"]).otherwise(more["v"]).alias("second"), "mean")


def confident(n: Column, top: Column, second: Column, mean: Column, least: int = 25, mean_ratio: float = 6.0, top_ratio: float = 1.85) -> Column:
    """Whether a read's longest cluster stands out from the mean or from the second."""
    return (n >= 2) & (top >= least) & ((top / mean >= mean_ratio) | (top / second >= top_ratio))


def longest_paths(paths: DataFrame) -> DataFrame:
    """(evt, rf, length): the longest path at each event and sequence."""
    return paths.groupBy("evt", "rf").agg(F.max("length").alias("length"))
