"""Repeat masking of sequences (doc_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import kmers
from strandflow.functions.intervals import merge
from strandflow.storage import kept


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over all sequences, upper case; k-mers with a letter other than a base are left out."""
    return seqs.select(F.explode(kmers.base_kmers(F.col("seq"), k)).alias("kmer")).groupBy(F.upper("kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """One row; of ties the last in the alphabet."""
    return counts.orderBy(F.col("n").desc(), F.col("kmer").desc()).limit(1)


def _covered(kmer: Column) -> Column:
    """A pattern of the letters that stand inside an occurrence of the k-mer: for each place in it, what is before and behind."""
    part = lambda a, n: F.concat(F.lit(r"\Q"), F.substr(kmer, a, n), F.lit(r"\E"))
    size = F.char_length(kmer)
    at = lambda i: F.concat(F.lit("(?<="), part(F.lit(1), i - 1), F.lit(")"), part(i, F.lit(1)), F.lit("(?="), part(i + 1, size - i), F.lit(")"))
    return F.concat(F.lit("(?i)"), F.array_join(F.transform(F.sequence(F.lit(1), size), at), "|"))


def mask_kmer(seq: Column, kmer: Column) -> Column:
    """Every occurrence, overlapping ones too, as N, in one pass; the search ignores case and other letters keep theirs."""
    return F.regexp_replace(seq, _covered(kmer), F.lit("N"))


def masked_hits(seq: Column, kmer: Column) -> Column:
    """How many occurrences ``mask_kmer`` masks, overlapping ones too."""
    return F.regexp_count(seq, F.concat(F.lit(r"(?i)(?=\Q"), kmer, F.lit(r"\E)"))).cast("long")


def mask_internal(seqs: DataFrame, k: int, rounds: int) -> DataFrame:
    """Mask the most frequent k-mer, count again, and so on. Each round's table is kept, so that a round costs two passes over it."""
    for _ in range(rounds):
        top = most_frequent(kmer_counts(seqs, k)).first()  # one row
        if top is None:
            break
        seqs = kept(seqs.withColumn("seq", mask_kmer(F.col("seq"), F.lit(top.kmer))))
    return seqs


def external_repeats(target: DataFrame, reference: DataFrame, k: int, min_copy: int, by: str = "item_id") -> DataFrame:
    """(by, st, en) intervals of a target's windows that occur more than ``min_copy`` times in the reference, on either strand."""
    windows = target.select(by, F.posexplode(kmers.kmers(F.col("seq"), k)).alias("st", "kmer"))
    wanted = windows.select("kmer").union(windows.select(kmers.reverse_complement(F.col("kmer")))).distinct()
    counts = kmer_counts(reference.select(F.col("seq")), k).join(wanted, "kmer", "left_semi")
    both = counts.union(counts.select(kmers.reverse_complement(F.col("kmer")), "n")).groupBy("kmer").agg(F.sum("n").alias("copies"))
    hits = windows.join(both, "kmer").filter(F.col("copies") > min_copy)
    return merge(hits.select(by, F.col("st").cast("long").alias("st"), (F.col("st") + k).cast("long").alias("en")), [by], "st", "en").select(by, "st", "en")


def apply_mask(seqs: DataFrame, bed: DataFrame, by: str = "item_id") -> DataFrame:
    """Half-open intervals of a sequence as N. Overlapping ones are joined first; what lies between is cut out by byte places (four bytes a letter)."""
    spans = merge(bed.filter("st < en").select(by, "st", "en"), [by], "st", "en").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("st", "en"))).alias("spans"))
    joined = seqs.join(spans, by, "left").withColumn("_wide", F.when(F.col("spans").isNotNull(), F.encode("seq", "UTF-32")))
    size = F.octet_length("_wide") / 4
    cut = lambda a, b: F.decode(F.substr("_wide", (4 * a + 1).cast("int"), (4 * F.greatest(b - a, F.lit(0))).cast("int")), "UTF-32")
    before = lambda i: F.when(i > 0, F.get("spans", i - 1)["en"]).otherwise(F.lit(0).cast("long"))
    inside = lambda x: F.greatest(F.least(x["en"], size) - F.greatest(x["st"], F.lit(0)), F.lit(0)).cast("int")
    pieces = F.transform("spans", lambda x, i: F.concat(cut(before(i), F.least(x["st"], size)), F.repeat(F.lit("N"), inside(x))))
    tail = cut(F.element_at("spans", -1)["en"], size)
    return joined.withColumn("seq", F.when(F.col("spans").isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("seq"))).drop("spans", "_wide")
