"""Traces of single reads: alignment strings, basecall moves, path histories, seed clusters, seed places.

Positions are 0-based and integer. Everything but cluster growth is a DataFrame plan; groups are single reads or clusters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations of an alignment string that move along the query and along the reference.
ALONG_QUERY, ALONG_REFERENCE = "M=XIS", "M=XDN"


def cigar_pairs(df: DataFrame, by: str, cigar: str = "cigar", qr_st: str = "qr_st", is_fwd: str = "is_fwd") -> DataFrame:
    """(by, qr, rf) for aligned positions; rf counts from the alignment's start. Operations run backwards on the reverse strand.

    An operation along one side only pairs that side's first position with the place where the other stands. A null or
    malformed string gives no rows. ``by`` must be unique.
    """
    ops = F.regexp_extract_all(F.col(cigar), F.lit("([0-9]+)[MIDNSHP=X]"), 1)
    kinds = F.regexp_extract_all(F.col(cigar), F.lit("[0-9]+([MIDNSHP=X])"), 1)
    pairs = F.arrays_zip(ops.alias("n"), kinds.alias("op"))
    pairs = F.when(F.col(is_fwd), pairs).otherwise(F.reverse(pairs))
    rows = df.select(by, F.col(qr_st).cast("long").alias("_q0"), F.posexplode(pairs).alias("_i", "_x"))
    n, op = F.col("_x.n").cast("long"), F.col("_x.op")
    rows = rows.select(by, "_q0", "_i", n.alias("_n"), F.instr(F.lit(ALONG_QUERY), op).alias("_q"), F.instr(F.lit(ALONG_REFERENCE), op).alias("_r"))
    before = Window.partitionBy(by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col("_n")).otherwise(0)).over(before), F.lit(0))
    rows = rows.withColumns({"_qs": F.col("_q0") + gone("_q"), "_rs": gone("_r")})
    steps = F.least(*[F.when(F.col(c) > 0, F.col("_n")).otherwise(1) for c in ("_q", "_r")])
    out = rows.filter(steps > 0).select(by, "_qs", "_rs", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("_k"))
    return out.select(by, (F.col("_qs") + F.col("_k")).alias("qr"), (F.col("_rs") + F.col("_k")).alias("rf"))


def packed_bits(packed: Column) -> Column:
    """The bits of a binary value, highest first, as an array of 0 and 1."""
    bits = F.transform(F.sequence(F.lit(0), F.octet_length(packed) - 1), lambda i: F.lpad(F.conv(F.hex(F.substr(packed, i + F.lit(1), F.lit(1))), 16, 2), 8, "0"))
    each = F.flatten(F.transform(bits, lambda b: F.split(b, "")))
    return F.when(F.octet_length(packed) > 0, F.transform(F.filter(each, lambda c: c != ""), lambda c: c.cast("int"))).otherwise(F.array().cast("array<int>"))


def basecall_places(df: DataFrame, pairs: DataFrame, by: str, stride: int = 5) -> DataFrame:
    """(by, sample, qr, rf): samples of basecalled steps with what their read base is aligned to.

    ``df``: by, packed (binary moves), sample_st. A step's read base is the number of moves up to and including it.
    """
    steps = df.select(by, "sample_st", F.posexplode(packed_bits(F.col("packed"))).alias("_i", "_m"))
    upto = Window.partitionBy(by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(by, (F.col("sample_st") + F.col("_i") * stride).alias("sample"), F.sum("_m").over(upto).alias("qr"))
    return steps.join(pairs, [by, "qr"]).select(by, "sample", "qr", "rf")


def path_places(df: DataFrame, by: str, moves: str = "moves") -> DataFrame:
    """(by, evt, rf) of each event of a path: moves (a string of 0 and 1, newest first) add up from the oldest; ``evt`` and ``rf`` of the path are its last event and first place."""
    back = F.reverse(F.col(moves))
    n = F.char_length(moves)
    rows = df.filter(n > 0).select(by, "evt", "rf", n.alias("_n"), back.alias("_b"), F.explode(F.sequence(F.lit(1), n)).alias("_k"))
    place = F.col("rf") + F.char_length(F.translate(F.substr(F.col("_b"), F.lit(1), F.col("_k")), "0", "")) - 1
    return rows.select(by, (F.col("evt") - F.col("_n") + F.col("_k")).alias("evt"), place.alias("rf"))


def seed_valid(length: Column, prob: Column, copies: Column, moves: Column, ended: Column, seed_len: int = 22, least: float = -3.75, stays: float = 0.5, most: int = 50, fewest_moves: int = 0) -> Column:
    """Whether a path is a seed. ``moves`` is its history as an integer, the newest step lowest, seed_len - 1 steps."""
    n = F.bit_count(moves)
    alone = (copies == 1) & (moves.bitwiseAND(F.lit(1).cast("long")) == 1) & (seed_len - 1 - n <= stays * seed_len)
    return (length == seed_len) & (prob >= least) & (alone | (ended & (copies <= most) & (n >= fewest_moves)))


def _hull(last: tuple, seed: tuple) -> tuple:
    """(cluster, block, sequence, start, end) of the block that a seed (cluster, rf, st, en) goes to, given the one before (empty at first)."""
    cluster, rf, st, en = seed
    if not last or last[0] != cluster:
        return cluster, 0, rf, st, en
    _, block, own, lo, hi = last
    if rf == own and max(lo, st) <= min(hi, en):
        return cluster, block, own, min(lo, st), max(hi, en)
    return cluster, block + 1, own, st, en


def growth(seeds: Iterable[tuple], last: tuple = (), covered: int = 0) -> Iterator[tuple[tuple, int, int]]:
    """(block, gain, covered) after each seed (cluster, rf, st, en), clusters one after another, each in event order.

    A seed that touches its cluster's last block and lies on the sequence of the cluster's first seed widens the block; any
    other begins one. The gain is what the block has become wider by. ``last`` and ``covered`` go on from an earlier part.
    """
    for before, block in pairwise(accumulate(seeds, _hull, initial=last)):
        same = before[:2] == block[:2]
        gain = block[4] - block[3] - (before[4] - before[3] if same else 0)
        covered = max(gain, 0) + (covered if before[:1] == block[:1] else 0)
        yield block, gain, covered


def cluster_growth(seeds: DataFrame) -> DataFrame:
    """seeds (cluster, n, rf, st, en) to (cluster, n, gain, covered, block); n is the order within a cluster. A cluster's seeds
    pass through one task in order, a batch at a time."""
    schema = pa.schema([(c, pa.int64()) for c in ("cluster", "n", "gain", "covered", "block")])

    def run(batches):
        last, covered = (), 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            rows = list(growth(zip(cols["cluster"], cols["rf"], cols["st"], cols["en"], strict=True), last, covered))
            if rows:
                last, _, covered = rows[-1]
            out = (cols["cluster"], cols["n"], [r[1] for r in rows], [r[2] for r in rows], [r[0][1] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    ordered = seeds.selectExpr("cast(cluster as bigint) cluster", "cast(n as bigint) n", "rf", "cast(st as bigint) st", "cast(en as bigint) en").repartition("cluster").sortWithinPartitions("cluster", "n")
    return ordered.mapInArrow(run, "cluster long, n long, gain long, covered long, block long")


def longest_clusters(grown: DataFrame, by: str = "read_id") -> DataFrame:
    """Each read's cluster that covers most; of ties the one that got there first."""
    best = F.max(F.struct("covered", (-F.col("n")).alias("n"), "cluster")).alias("b")
    return grown.groupBy(by).agg(best).select(by, F.col("b.cluster").alias("cluster"), F.col("b.covered").alias("covered"))


def cluster_report(clusters: DataFrame, by: str, most: int = 10) -> DataFrame:
    """The ``most`` longest clusters of each read (a report), with length ratio and reciprocal overlap against its longest."""
    from strandflow.functions.intervals import reciprocal_overlap

    order = Window.partitionBy(by).orderBy(F.col("covered").desc(), "cluster")
    top = lambda c: F.first(c).over(order)
    ranked = clusters.withColumns({"place": F.row_number().over(order), "_l": top("covered"), "_s": top("st"), "_e": top("en")}).filter(F.col("place") <= most)
    overlap = reciprocal_overlap((F.col("_s"), F.col("_e")), (F.col("st"), F.col("en")))
    return ranked.select(by, "cluster", "place", (F.col("_l") / F.col("covered")).alias("ratio"), overlap.alias("overlap"))


def seed_places(seeds: DataFrame, suffixes: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """seeds (by, seed, lo, hi, len) to (by, seed, st): the start on the other strand's coordinates of every rank of the range.

    ``suffixes``: by, rank, pos; ``sizes``: by, size. Ranks meet the suffix table in an equi-join.
    """
    ranks = seeds.filter("lo <= hi").select(by, "seed", "len", F.explode(F.sequence("lo", "hi")).alias("rank"))
    return ranks.join(suffixes, [by, "rank"]).join(sizes, by).select(by, "seed", (F.col("size") - F.col("pos") - F.col("len")).alias("st"))


def span_ranks(spans: DataFrame, suffixes: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Ranks of all suffixes that start inside a span [st, en) or inside its mirror on the other strand: (by, span, rank)."""
    both = spans.join(sizes, by).select(by, "span", F.explode(F.array(F.struct("st", "en"), F.struct((F.col("size") - F.col("en")).alias("st"), (F.col("size") - F.col("st")).alias("en")))).alias("x"))
    places = both.filter("x.st < x.en").select(by, "span", F.explode(F.sequence(F.col("x.st"), F.col("x.en") - 1)).alias("pos"))
    return places.join(suffixes, [by, "pos"]).select(by, "span", "rank").distinct()
