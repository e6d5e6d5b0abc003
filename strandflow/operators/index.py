"""Reference index: suffix arrays, backward search and what is read off them.

As tables: ``suffix_table`` ranks the suffixes of each sequence by prefix doubling over windows (no driver data),
``kmer_ranges`` gives each k-mer's rank range. As an object: ``FmIndex`` holds one reference's suffix array and
occurrence counts in NumPy for the mapping kernel; references go up to some 10 M bases (see ``MAX_BASES``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import kmers
from strandflow.storage import kept

MAX_BASES = 20_000_000
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)


def suffix_table(seqs: DataFrame, by: str = "doc_id", first: int = 10) -> DataFrame:
    """(by, pos, rank) of every suffix, by prefix doubling until no two of a sequence share a rank.

    A rank is the number of suffixes that are smaller as far as has been looked. The first ranks are those of prefixes of
    ``first`` letters, of which there are few; after that only suffixes of one rank are ordered among themselves, by the
    rank of what follows, so that no step sorts a whole sequence. ``by`` must be unique.
    """
    places = seqs.filter(F.char_length("seq") > 0).select(by, F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s)(?=(.{{1,{first}}}))"), F.lit(1))).alias("pos", "_p"))
    counts = places.groupBy(by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    smaller = F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), F.coalesce(smaller, F.lit(0)).alias("rank"))
    df = kept(places.join(ranks, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q"))).select(by, "pos", "rank"))
    step = first
    while not df.groupBy(by, "rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        ahead = df.select(F.col(by).alias("_by"), (F.col("pos") - step).alias("_pos"), F.col("rank").alias("_ahead"))
        df = df.join(ahead, F.col(by).eqNullSafe(F.col("_by")) & (F.col("pos") == F.col("_pos")), "left").select(by, "pos", "rank", F.coalesce("_ahead", F.lit(-1)).alias("_ahead"))
        among = F.rank().over(Window.partitionBy(by, "rank").orderBy("_ahead")) - 1
        df = kept(df.select(by, "pos", (F.col("rank") + among).alias("rank")))
        step *= 2
    return df


def kmer_ranges(suffixes: DataFrame, seqs: DataFrame, k: int, by: str = "doc_id") -> DataFrame:
    """(by, kmer, lo, hi) over suffixes that begin with the k-mer."""
    starts = seqs.select(by, F.posexplode(kmers.kmers(F.col("seq"), k)).alias("pos", "kmer"))
    return suffixes.join(starts, [by, "pos"]).groupBy(by, "kmer").agg(F.min("rank").cast("long").alias("lo"), F.max("rank").cast("long").alias("hi"))


def repeats(seqs: DataFrame, k: int, by: str = "doc_id") -> DataFrame:
    """(by, pos, kmer, copies): how often the k-mer at each place occurs in its sequence."""
    starts = seqs.select(by, F.posexplode(kmers.kmers(F.col("seq"), k)).alias("pos", "kmer"))
    counts = starts.groupBy(by, "kmer").agg(F.count(F.lit(1)).alias("copies"))
    return starts.join(counts, [by, "kmer"]).select(by, F.col("pos").cast("long").alias("pos"), "kmer", "copies")


def self_align(seqs: DataFrame, lengths: list[int], sample: int = 1, by: str = "doc_id") -> DataFrame:
    """(by, pos, len, copies) at sampled places (a hash of the place, 1 in ``sample``) for each substring length."""
    parts = [repeats(seqs, n, by).select(by, "pos", F.lit(n).alias("len"), "copies") for n in lengths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if sample == 1 else out.filter(F.pmod(F.xxhash64(by, "pos"), F.lit(sample)) == 0)


def locate(points: DataFrame, refs: DataFrame, width: int = 1000) -> DataFrame:
    """Concatenated positions ``p`` to the sequence (offset <= p < offset + len) that holds them."""
    from strandflow.functions.intervals import range_join

    spans = refs.withColumn("_end", F.col("offset") + F.col("len"))
    return range_join(points, "p", spans, "offset", "_end", width).drop("_end").withColumn("local", F.col("p") - F.col("offset"))


def preset_thresholds(line: Column, bins: int = 64) -> Column:
    """A preset's comma list to ``bins`` thresholds by bin number; the list fills from the highest bin down and its last value fills the rest."""
    values = F.transform(F.split(line, ","), lambda v: v.cast("double"))
    n = F.size(values)
    return F.transform(F.sequence(F.lit(bins - 1), F.lit(0)), lambda i: F.get(values, F.least(i, n - 1)))


def threshold_bin(length: Column) -> Column:
    """Leading zeros of the 64-bit range length."""
    return 64 - F.char_length(F.conv(length, 10, 2))


def concatenated(points: DataFrame, refs: DataFrame, name: str = "name", local: str = "local") -> DataFrame:
    """Places ``p`` in the concatenation of (name, local) points; null for a name that ``refs`` (name, offset, len) does not have."""
    known = refs.select(F.col("name").alias("_n"), F.col("offset").alias("_o"))
    return points.join(known, F.col(name) == F.col("_n"), "left").withColumn("p", F.col("_o") + F.col(local)).drop("_n", "_o")


class Reference:
    """Sequences one behind the other, an N after each, so that no match runs over an end; and a place's sequence."""

    def __init__(self, seqs: list[tuple[str, str]]):
        self.names = [n for n, _ in seqs]
        self.sizes = np.array([len(s) for _, s in seqs], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1] if seqs else np.empty(0, dtype=np.int64)
        self.text = "".join(f"{s}N" for _, s in seqs)

    def at(self, place: int) -> tuple[str, int, int]:
        """(name, local place, length) of the sequence that holds a place."""
        i = int(np.searchsorted(self.offsets, place, side="right")) - 1
        return self.names[i], place - int(self.offsets[i]), int(self.sizes[i])


def store_index(spark, seqs: list[tuple[str, str]], path: str, block: int = 1 << 18) -> None:
    """The reference and its suffix array as Parquet: sorted once here, read by every mapping after. At most MAX_BASES bases."""
    ref = Reference(seqs)
    sa = FmIndex(ref.text).sa.astype("<i4")
    spark.createDataFrame(list(zip(ref.names, (s for _, s in seqs), range(len(seqs)), strict=True)), "name string, seq string, i long").write.parquet(f"{path}/sequences")
    spark.createDataFrame([(i, sa[i : i + block].tobytes()) for i in range(0, len(sa), block)], "i long, sa binary").write.parquet(f"{path}/suffixes")


def load_index(spark, path: str) -> tuple[Reference, np.ndarray]:
    """The stored reference and suffix array. What is stored is at most MAX_BASES bases and four bytes a suffix, so it may be broadcast."""
    seqs = [(r.name, r.seq) for r in spark.read.parquet(f"{path}/sequences").orderBy("i").collect()]
    parts = spark.read.parquet(f"{path}/suffixes").orderBy("i").collect()
    return Reference(seqs), np.frombuffer(b"".join(bytes(r.sa) for r in parts), dtype="<i4")


class FmIndex:
    """Backward search over a text and its reverse complement, built so that appending a base to a match is one step.

    The indexed text is the reversed concatenation of both strands; a match of length m at place p of it stands at
    ``len(text) - p - m`` of the concatenation. Letters other than bases match nothing. ``sa`` is a suffix array made before.
    """

    def __init__(self, seq: str, sa: np.ndarray | None = None):
        if len(seq) > MAX_BASES:
            raise ValueError(f"references are limited to {MAX_BASES} bases")
        fwd = _CODE[np.frombuffer(seq.upper().encode(), dtype=np.uint8)]
        self.size = 2 * len(fwd)
        text = np.concatenate((fwd, np.where(fwd > 3, 4, 3 - fwd)[::-1]))[::-1].astype(np.uint8)
        self.sa = self._suffixes(text) if sa is None else sa
        before = np.where(self.sa > 0, text[self.sa - 1], 4)
        self.counts = np.zeros((4, self.size + 1), dtype=np.int32)
        for b in range(4):
            np.cumsum(before == b, out=self.counts[b, 1:])
        # the suffix that is empty sorts first and stands for the text's end
        total = np.array([(text == b).sum() for b in range(4)])
        self.first = np.concatenate(([0], np.cumsum(total)))
        self.end_base = int(text[-1]) if self.size else 0

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        n = len(text)
        rank = text.astype(np.int64)
        step = 1
        while True:
            ahead = np.full(n, -1, dtype=np.int64)
            ahead[: n - step] = rank[step:] if step < n else ahead[: max(0, n - step)]
            order = np.lexsort((ahead, rank))
            new = np.empty(n, dtype=np.int64)
            changed = np.concatenate(([0], (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])))
            new[order] = np.cumsum(changed)
            rank, step = new, 2 * step
            if n == 0 or rank.max() == n - 1 or step >= n * 2:
                return np.argsort(rank, kind="stable")

    def base_range(self, base: int) -> tuple[int, int]:
        """Half-open rank range of the suffixes that begin with the base."""
        return int(self.first[base]), int(self.first[base + 1])

    def extend(self, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the matches put behind one more base (vectorised); lo >= hi is empty.

        The whole text's last character is preceded by nothing in ``sa`` order, so its suffix counts as rank ``first``
        of its base: that one is added for ranges after it.
        """
        extra = (base == self.end_base).astype(np.int64)
        return self.first[base] + self.counts[base, lo] + extra * 1, self.first[base] + self.counts[base, hi] + extra * 1

    def search(self, seq: str) -> tuple[int, int]:
        """Half-open range of a whole string's matches."""
        codes = _CODE[np.frombuffer(seq.upper().encode(), dtype=np.uint8)]
        if (codes > 3).any() or not len(codes):
            return 0, 0
        lo, hi = self.base_range(int(codes[0]))
        for b in codes[1:]:
            lo, hi = (int(x[0]) for x in self.extend(np.array([lo]), np.array([hi]), np.array([b])))
        return lo, hi

    def places(self, lo: int, hi: int, m: int) -> np.ndarray:
        """Starts in the two-strand concatenation of the matches of length m."""
        return self.size - self.sa[lo:hi] - m
