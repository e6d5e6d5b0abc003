"""MinHash near-duplicate detection with sequential Bayesian verification.

1. One pass over the texts makes each document's shingle set (64-bit hashes), its size, a 128-bit digest of
   the set, band keys and a short signature; this narrow table is written to the shared folder.
2. Rows with equal sets collapse to one class (by digest, with a number of its own) before any pairing, so that
   repeated rows cost no more than their own rows. The set of a class that meets another is made once.
3. Classes meet in band buckets. Pairs are tried in three rounds, and each round leaves out pairs that
   are already in one component: (i) each member with the first of its buckets' leaders (a leader is the member with
   the smallest doc_id), (ii) each member with every leader of its buckets, (iii) pairs from buckets whose members still lie in different components. For (iii)
   the documents of such buckets give their whole sets, ordered by how many of these documents hold a shingle,
   rarest first. Two linked documents must meet in a shingle of both prefixes, early enough that what follows can
   still make up the overlap; pairs are made where that holds. A passage that many documents share stands last in
   this order and makes no pairs, nor do near misses of one template, and no link is lost.
4. A candidate's signatures are compared in batches; it goes as soon as the posterior probability that the
   similarity reaches the threshold falls under MISS. Survivors are confirmed on the full sets.
5. Confirmed links are contracted to components by alternating large-star and small-star steps. A component is
   named by the smallest doc_id of its rows.

With ROWS = 5 and BANDS = 30 a pair at similarity 0.8 shares no band with probability 0.672^30 = 7e-6.

Edge cases: null or empty texts, and texts without words, have an empty set and are linked with nothing
(component_id = doc_id); a text of fewer than k words has its whole sequence as its one shingle. Every row is a
document of its own: rows that share a doc_id are linked only if their texts are, repeated rows are copies of each
other, and a row with a null doc_id is linked like others (component_id is null only if no row of the component has
a doc_id). Ties need no rule, as a component has one smallest doc_id. Very long texts give long sets, which travel in
batches bounded in bytes. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandflow.llm.common import bound_batches, plain, remove, scratch_path, shared_dir, stored, unpacked

ROWS, BANDS = 5, 30
N_HASH = ROWS * BANDS
#: Miss probability of one batch of the sequential test, and hashes compared in a batch.
MISS, STEP = 1e-5, 15
#: doc_ids (8 bytes each) up to which the filter on candidates' texts is broadcast, after counting them; beyond, it is a shuffled join with the same result.
BROADCAST_IDS = 200_000
#: Words whose hashes a worker remembers.
CACHE = 300_000

_rng = np.random.default_rng(20240117)
_A = (_rng.integers(0, 2**32, (N_HASH, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, (N_HASH, 1), dtype=np.uint32)
_MIX = (_rng.integers(0, 2**63, ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


_WORDS = _WordHash()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = _scramble(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(N_HASH, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048] * _A + _B).min(axis=1))
    return low


def _prepare(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            full = [s for s in sigs if s is not None]
            if full:
                m = np.stack(full).reshape(len(full), BANDS, ROWS).astype(np.uint64)
                keys = _scramble((_scramble(m * _MIX)).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)
                it = iter(keys)
            bands = [None if s is None else next(it) for s in sigs]
            short = [None if s is None else s.astype("<u2").tobytes() for s in sigs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())], schema=schema)

    return run


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): under it, P(similarity >= threshold | matches) < MISS.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1), so that
    probability is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, N_HASH + 1, STEP):
        total, m = 0.0, -1
        while total < MISS:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _prune(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    bounds = least_matches(percent / 100)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, N_HASH) for c in ("sig_a", "sig_b"))
            alive = np.arange(len(x))
            matches = np.zeros(len(x), dtype=np.int64)
            for n, least in bounds:
                matches[alive] += (x[alive, n - STEP : n] == y[alive, n - STEP : n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], schema=schema)

    return run


def _set_rows(k: int):
    schema = pa.schema([("digest", pa.binary()), ("own", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _shingles(batches):
    schema = pa.schema([("id", pa.int64()), ("c", pa.int64()), ("size", pa.int64()), ("t", pa.list_(pa.int64()))])
    for batch in batches:
        sets = [np.frombuffer(s.as_py(), dtype=np.int64) for s in batch.column("own")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                s, t = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], schema=schema)

    return run


def components(edges: DataFrame, under: str | None = None) -> DataFrame:
    """(id, comp) for every id of the edges (a, b); comp is the smallest id that is reachable. Rounds are written ``under`` a folder."""
    pair = lambda x, y: [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = stored(edges.select(*pair(F.col("a"), F.col("b"))).filter("a <> b").distinct(), "edges", under)
    seen = state(e)
    while seen[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        e = both.join(low, F.col("u") == F.col("lu")).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "la")
        e = e.join(low, F.col("a") == F.col("la")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(*pair(F.col("b"), F.col("m"))))).alias("x")).select("x.*").filter("a <> b").distinct()
        e = stored(e, "edges", under)
        seen, before = state(e), seen
        if seen == before:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())


def _with_comp(df: DataFrame, comp: DataFrame, by: str, name: str) -> DataFrame:
    """The component of the class in column ``by``; its own number where it has no link."""
    return df.join(comp.select(F.col("id").alias("ci"), F.col("comp").alias("cc")), F.col(by) == F.col("ci"), "left").withColumn(name, F.coalesce("cc", F.col(by))).drop("ci", "cc")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(prep, classes): a row (doc_id, n_shingles, digest) per input row, and a row (digest, id, rep, comp) per class of equal sets."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared_dir(spark)
    work = scratch_path(spark, "near-dup")
    keep = lambda df, label: stored(df, label, work)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prep = stored(texts.mapInArrow(_prepare(k), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"), "minhash")
    # a class is numbered as it is written, so its number stands from then on; ``o`` orders classes by their smallest doc_id
    groups = prep.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    number = F.monotonically_increasing_id()
    groups = keep(groups.select(number.alias("id"), F.coalesce("rep", number).alias("o"), "digest", "rep", "bands", "sig"), "groups")

    bands = groups.select("id", "o", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.min("o").alias("lead"), F.min("id").alias("i1"), F.max("id").alias("i2")).filter("i1 < i2").select(F.col("key").alias("k"), "lead")
    # written first: a join with a bare shuffle on both sides can split a hot key, one with an aggregate can't
    full = keep(full, "full")
    multi = keep(bands.join(full, F.col("key") == F.col("k")).select("key", "id", "o", "lead"), "buckets")

    # sets and signatures of the classes that share a bucket with another, one row each
    ids = keep(multi.select(F.col("id").alias("near")).distinct(), "ids")
    near = keep(groups.select("id", "o", "digest", "rep", "sig").join(ids, F.col("id") == F.col("near"), "left_semi"), "near")
    reps = keep(near.select(F.col("rep").alias("near_rep")).distinct(), "reps")
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    sets = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("near_rep")), "left_semi").select("text").mapInArrow(_set_rows(k), "digest binary, own binary")
    sets = sets.filter("digest is not null").groupBy("digest").agg(F.any_value("own").alias("own"))
    sets = keep(sets.join(near.select(F.col("digest").alias("d"), "id"), F.col("digest") == F.col("d")).select("id", "own"), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b). b may be hot: it is joined last, by joins whose skewed partitions can be split."""
        x = pairs.join(near.select(F.col("id").alias("ia"), F.col("sig").alias("sig_a")), F.col("a") == F.col("ia")).select("a", "b", "sig_a")
        x = x.join(near.select(F.col("id").alias("ib"), F.col("sig").alias("sig_b")), F.col("b") == F.col("ib")).select("a", "b", "sig_a", "sig_b")
        alive = keep(x.mapInArrow(_prune(percent), "a long, b long"), "alive")
        x = alive.join(sets.select(F.col("id").alias("ia"), F.col("own").alias("set_a")), F.col("a") == F.col("ia")).select("a", "b", "set_a")
        x = x.join(sets.select(F.col("id").alias("ib"), F.col("own").alias("set_b")), F.col("b") == F.col("ib")).select("a", "b", "set_a", "set_b")
        return keep(x.mapInArrow(_confirm(percent), "a long, b long"), "links")

    # the class that leads a bucket: originals tend to come first, so most copies are linked with theirs in the first round
    leaders = keep(near.groupBy("o").agg(F.min("id").alias("b")).withColumnRenamed("o", "lo"), "leaders")
    led = lambda df: df.join(leaders, F.col("lead") == F.col("lo")).select("a", "b").filter("a <> b")
    stars = multi.filter("lead < o").select(F.col("id").alias("a"), "lead")
    # (i) each member with the first of its leaders
    first = keep(stars.groupBy("a").agg(F.min("lead").alias("lead")), "first")
    links = verify(led(first))
    comp = keep(components(links, work), "comp")
    # (ii) with the leader of each bucket
    stars = keep(stars.distinct(), "stars")
    todo = stars.join(first.select(F.col("a").alias("fa"), F.col("lead").alias("fl")), (F.col("a") == F.col("fa")) & (F.col("lead") == F.col("fl")), "left_anti")
    todo = _with_comp(_with_comp(led(todo), comp, "a", "ca"), comp, "b", "cb").filter("ca <> cb").select("a", "b")
    links = links.union(verify(todo))
    comp = keep(components(links, work), "comp")
    # (iii) what is still apart in a bucket
    member = keep(_with_comp(multi.select("key", "id"), comp, "id", "c"), "members")
    kinds = member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = kinds.groupBy(F.col("key").alias("k")).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("k")
    mixed = keep(mixed, "mixed")
    inside = member.join(mixed, F.col("key") == F.col("k"), "left_semi").select("id", "c").distinct()
    inside = inside.join(sets.select(F.col("id").alias("ti"), "own"), F.col("id") == F.col("ti")).select("id", "c", "own")
    shingle = keep(inside.mapInArrow(_shingles, "id long, c long, size long, t array<long>"), "shingles").select("id", "c", "size", F.explode("t").alias("t"))
    often = shingle.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).select(F.col("t").alias("ot"), "n", (F.col("c1") < F.col("c2")).alias("apart"))
    often = keep(often, "often")
    ordered = shingle.join(often, F.col("t") == F.col("ot")).withColumn("at", F.row_number().over(Window.partitionBy("id", "size").orderBy("n", "t")))
    early = ordered.filter((100 * (F.col("size") - F.col("at") + 1) >= percent * F.col("size")) & F.col("apart"))
    early = keep(early.select("id", "c", "size", "t", "at"), "prefixes")
    most = early.groupBy("t", "c").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("t").alias("mt")).agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    most = keep(most, "most")
    both = early.join(most, F.col("t") == F.col("mt")).select("t", "id", "c", "main", "size", "at")
    left = both.filter("c <> main")
    right = both.select(F.col("t").alias("t2"), F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("size").alias("size2"), F.col("at").alias("at2"))
    apart = (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("id") < F.col("id2")))
    # from here on at most so many shingles can be common; a link needs percent / (100 + percent) of both sizes
    enough = (100 + percent) * (1 + F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))) >= percent * (F.col("size") + F.col("size2"))
    rest = left.join(right, (F.col("t") == F.col("t2")) & apart & enough)
    rest = rest.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()
    tried = keep(led(stars).select(F.greatest("a", "b").alias("fa"), F.least("a", "b").alias("fb")), "tried")
    rest = rest.join(tried, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left_anti")
    more = verify(rest)
    if not more.isEmpty():
        comp = keep(components(links.union(more), work), "comp")

    classes = stored(_with_comp(groups.select("digest", "id", "rep"), comp, "id", "comp"), "classes")
    remove(spark, work)
    return prep.select("doc_id", "n_shingles", "digest"), classes


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id (smallest doc_id reachable over links of similarity >= percent / 100)."""
    prep, classes = _classes(docs, k, percent)
    # only components of several classes need a name of their own
    low = classes.groupBy(F.col("comp").alias("lc")).agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("lc", "least")
    low = stored(low, "names")
    named = classes.join(low, F.col("comp") == F.col("lc"), "left").select(F.col("digest").alias("d"), F.coalesce("least", "rep").alias("component"))
    out = prep.join(named, F.col("digest") == F.col("d"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component stays, with the input's columns: one with the component's smallest doc_id (a null one last).

    Rows without words all stay. Of repeated rows one stays, that with the smallest hash of its columns; rows that share a doc_id
    are told apart by their texts.
    """
    prep, classes = _classes(docs, k, percent)
    best = classes.groupBy(F.col("comp").alias("bc")).agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("id").alias("id"))).alias("best"))
    winners = stored(best.join(classes, F.col("best.id") == F.col("id")).select(F.col("digest").alias("d"), F.col("rep").alias("kept")), "winners")
    many = stored(prep.groupBy(F.col("doc_id").alias("many")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("many"), "many")
    # a doc_id of one row stands for it: what is not kept goes
    gone = prep.filter("digest is not null").join(winners, F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("kept")), "left_anti").select(F.col("doc_id").alias("gone"))
    rows = plain(docs, "doc_id", "text", carry=True).withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = stored(gone.union(many).distinct(), "gone")
    single = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
    if many.isEmpty():
        return unpacked(single, docs)
    shared = rows.join(many, F.col("doc_id").eqNullSafe(F.col("many")), "left_semi").select("doc_id", F.col("text").cast("binary").alias("text"), "row")
    kind = StructType([StructField("doc_id", LongType()), StructField("digest", BinaryType()), StructField("row", rows.schema["row"].dataType)])
    shared = shared.mapInArrow(_digest_rows(k), kind)
    one = shared.join(winners, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("kept"))).groupBy("digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return unpacked(single.select("row").unionByName(shared.filter("digest is null").select("row")).unionByName(one.select("row")), docs)


def _digest_rows(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s) if s else None for s in sets], pa.binary()), batch.column("row")], names=["doc_id", "digest", "row"])

    return run
