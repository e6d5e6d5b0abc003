"""Queries over single reads' traces, seeds, presets and simulated channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import kmers as K
from strandflow.functions import signal as S
from strandflow.operators import index as I
from strandflow.operators import presets, runprofile, simulate
from strandflow.operators import traces as T
from strandflow.plans import adapters as A
from strandflow.plans.adapters import ITEMS, query
from strandflow.sources import readers


def _pairs(src: str, by: str) -> str:
    """CTEs from ``src`` (by, cigar, qr_st, is_fwd) to pr (by, qr, rf)."""
    runs = "strpos('{}', o) > 0"
    q, r = runs.format(T.ALONG_QUERY), runs.format(T.ALONG_REFERENCE)
    return f"""op AS (SELECT {by}, qr_st, is_fwd, regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1) AS n, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS k FROM {src}),
od AS (SELECT {by}, qr_st, CASE WHEN is_fwd THEN n ELSE list_reverse(n) END AS n, CASE WHEN is_fwd THEN k ELSE list_reverse(k) END AS k FROM op),
ex AS (SELECT {by}, qr_st, unnest(range(1, len(n) + 1)) AS i, CAST(unnest(n) AS BIGINT) AS n, unnest(k) AS o FROM od),
pl AS (SELECT {by}, qr_st + coalesce(sum(CASE WHEN {q} THEN n ELSE 0 END) OVER w, 0) AS qs, coalesce(sum(CASE WHEN {r} THEN n ELSE 0 END) OVER w, 0) AS rs, least(CASE WHEN {q} THEN n ELSE 1 END, CASE WHEN {r} THEN n ELSE 1 END) AS steps FROM ex
  WINDOW w AS (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ks AS (SELECT {by}, qs, rs, unnest(range(0, steps)) AS d FROM pl), pr AS (SELECT {by}, CAST(qs + d AS BIGINT) AS qr, CAST(rs + d AS BIGINT) AS rf FROM ks)"""


_CIGAR = "a AS (SELECT o_orderkey AS id, (o_orderkey % 5 + 1) || 'S' || (o_custkey % 20 + 3) || 'M' || (o_custkey % 3 + 1) || 'I' || (o_orderkey % 7 + 2) || '=' || (o_custkey % 4 + 1) || 'D3M' AS cigar, o_custkey % 10 AS qr_st, o_orderstatus = 'O' AS is_fwd FROM orders)"


@query(f"WITH {_CIGAR}, {_pairs('a', 'id')} SELECT id, qr, rf FROM pr")
def cigar_coordinates(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    cigar = F.concat((o % 5 + 1).cast("string"), F.lit("S"), (c % 20 + 3).cast("string"), F.lit("M"), (c % 3 + 1).cast("string"), F.lit("I"), (o % 7 + 2).cast("string"), F.lit("="), (c % 4 + 1).cast("string"), F.lit("D3M"))
    a = A.table(spark, sf, "orders").select(o.alias("id"), cigar.alias("cigar"), (c % 10).alias("qr_st"), (F.col("o_orderstatus") == "O").alias("is_fwd"))
    return T.cigar_pairs(a, "id")


_MOVES = """a AS (SELECT item_id AS id, (length(text) % 7 + 3) || 'M2I' || (length(text) % 5 + 20) || 'M3D40M' AS cigar, 1 AS qr_st, item_id % 2 = 0 AS is_fwd, hex(encode(text)) AS h FROM benchmark),
b AS (SELECT id, unnest(range(0, 4 * length(h))) AS i, h FROM a), m AS (SELECT id, i, ((strpos('0123456789ABCDEF', substr(h, CAST(i // 4 + 1 AS BIGINT), 1)) - 1) >> (3 - i % 4)) & 1 AS x FROM b),
s AS (SELECT id, id * 100 + i * 5 AS sample, sum(x) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS qr FROM m)"""


@query(f"WITH {_MOVES}, {_pairs('a', 'id')} SELECT id, sample, qr, rf FROM s JOIN pr USING (id, qr)")
def basecall_samples(spark, sf):
    n = F.char_length("text")
    cigar = F.concat((n % 7 + 3).cast("string"), F.lit("M2I"), (n % 5 + 20).cast("string"), F.lit("M3D40M"))
    a = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), cigar.alias("cigar"), F.lit(1).alias("qr_st"), (F.col("item_id") % 2 == 0).alias("is_fwd"), F.col("text").cast("binary").alias("packed"), (F.col("item_id") * 100).alias("sample_st"))
    return T.basecall_places(a, T.cigar_pairs(a, "id"), "id")


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber * 10 AS evt, l_suppkey AS rf, reverse(bin(l_partkey)) AS b FROM lineitem), e AS (SELECT *, unnest(range(1, length(b) + 1)) AS k FROM p)
SELECT id, CAST(evt - length(b) + k AS BIGINT) AS evt, CAST(rf + length(replace(substr(b, 1, k), '0', '')) - 1 AS BIGINT) AS rf FROM e""")
def path_coordinates(spark, sf):
    p = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10).cast("long").alias("evt"), F.col("l_suppkey").alias("rf"), F.bin("l_partkey").alias("moves"))
    return T.path_places(p, "id")


_SEED = "SELECT l_orderkey AS id, CASE WHEN l_quantity > 5 THEN 22 ELSE 21 END AS length, -l_tax * 50 AS prob, l_suppkey % 60 AS copies, l_partkey * 1021 % 2097152 AS moves, l_returnflag = 'R' AS ended FROM lineitem"


@query(f"WITH s AS ({_SEED}) SELECT id, moves, length = 22 AND prob >= -3.75 AND ((copies = 1 AND moves & 1 = 1 AND 21 - bit_count(moves) <= 11) OR (ended AND copies <= 50)) AS valid FROM s")
def seed_validity(spark, sf):
    li = A.table(spark, sf, "lineitem")
    s = li.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_quantity") > 5, 22).otherwise(21).alias("length"), (-F.col("l_tax") * 50).alias("prob"), (F.col("l_suppkey") % 60).alias("copies"), (F.col("l_partkey") * 1021 % 2097152).alias("moves"), (F.col("l_returnflag") == "R").alias("ended"))
    return s.select("id", "moves", T.seed_valid(*[F.col(c) for c in ("length", "prob", "copies", "moves", "ended")]).alias("valid"))


_GROWN = """s AS MATERIALIZED (SELECT user_id AS cluster, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_id % 17 = 0 THEN 'b' ELSE 'a' END AS rf, CAST(floor(value * 4) AS BIGINT) AS st, CAST(floor(value * 4) AS BIGINT) + 22 AS en FROM events),
g AS (SELECT cluster, n, rf AS own, st AS lo, en AS hi, en - st AS gain, en - st AS covered, 0 AS block FROM s WHERE n = 1 UNION ALL
  SELECT s.cluster, s.n, own, CASE WHEN apart THEN s.st ELSE least(lo, s.st) END, CASE WHEN apart THEN s.en ELSE greatest(hi, s.en) END, gained, covered + greatest(gained, 0), block + CAST(apart AS INT)
  FROM (SELECT s.*, own, lo, hi, covered, block, s.rf <> own OR greatest(lo, s.st) > least(hi, s.en) AS apart, CASE WHEN s.rf <> own OR greatest(lo, s.st) > least(hi, s.en) THEN s.en - s.st ELSE greatest(hi, s.en) - least(lo, s.st) - (hi - lo) END AS gained FROM g JOIN s ON s.cluster = g.cluster AND s.n = g.n + 1) s)"""


@query(f"WITH RECURSIVE {_GROWN} SELECT cluster, n, gain, covered, CAST(block AS BIGINT) AS block FROM g")
def cluster_growth(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    st = F.floor(F.col("value") * 4).cast("long")
    seeds = A.table(spark, sf, "events").select(F.col("user_id").alias("cluster"), F.row_number().over(w).cast("long").alias("n"), F.when(F.col("event_id") % 17 == 0, "b").otherwise("a").alias("rf"), st.alias("st"), (st + 22).alias("en"))
    return T.cluster_growth(seeds)


@query(f"WITH RECURSIVE {_GROWN} SELECT cluster % 7 AS read_id, cluster, covered FROM g QUALIFY row_number() OVER (PARTITION BY cluster % 7 ORDER BY covered DESC, n, cluster DESC) = 1")
def longest_cluster(spark, sf):
    return T.longest_clusters(cluster_growth(spark, sf).withColumn("read_id", F.col("cluster") % 7))


@query("""WITH c AS (SELECT l_orderkey AS read_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS cluster, CAST(l_quantity AS BIGINT) AS covered, l_partkey % 50 AS st, l_partkey % 50 + CAST(l_quantity AS BIGINT) AS en FROM lineitem),
r AS (SELECT *, row_number() OVER w AS place, first(covered) OVER w AS l, first(st) OVER w AS s, first(en) OVER w AS e FROM c WINDOW w AS (PARTITION BY read_id ORDER BY covered DESC, cluster))
SELECT read_id, cluster, place, round(l / covered, 4) AS ratio, round(CASE WHEN s <= en AND st <= e THEN (least(e, en) - greatest(s, st) + 1) / (greatest(e, en) - least(s, st) + 1) ELSE 0 END, 4) AS overlap FROM r WHERE place <= 4""")
def cluster_ranking(spark, sf):
    q = F.col("l_quantity").cast("long")
    c = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * F.lit(10000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("cluster"), q.alias("covered"), (F.col("l_partkey") % 50).alias("st"), (F.col("l_partkey") % 50 + q).alias("en"))
    out = T.cluster_report(c, "read_id", 4)
    return out.select("read_id", "cluster", F.col("place").cast("long").alias("place"), F.round("ratio", 4).alias("ratio"), F.round("overlap", 4).alias("overlap"))


_BOTH = f"{ITEMS}, b AS (SELECT item_id, length(seq) AS n, seq || reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM items)"


def _both(spark, sf):
    """(strands, their suffix table, their sizes) of the items."""
    b = A.items(spark, sf).select("item_id", F.concat("seq", K.reverse_complement(F.col("seq"))).alias("seq"))
    return b, I.suffix_table(b, by="item_id"), b.select("item_id", F.char_length("seq").cast("long").alias("size"))


@query(f"WITH {_BOTH}, w AS (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - 3, 0))) AS pos FROM b) SELECT item_id, substr(seq, pos + 1, 4) AS seed, CAST(length(seq) - pos - 4 AS BIGINT) AS st FROM w")
def seed_starts(spark, sf):
    b, suffixes, sizes = _both(spark, sf)
    seeds = I.kmer_ranges(suffixes, b, 4, by="item_id").select("item_id", F.col("kmer").alias("seed"), "lo", "hi", F.lit(4).alias("len"))
    return T.seed_places(seeds, suffixes, sizes, "item_id")


@query(f"""WITH {_BOTH}, w AS (SELECT item_id, n, seq, unnest(range(0, length(seq))) AS pos FROM b), r AS (SELECT item_id, n, pos, row_number() OVER (PARTITION BY item_id ORDER BY substr(seq, pos + 1)) - 1 AS rank FROM w)
SELECT item_id, 'head' AS span, rank FROM r WHERE (pos >= 2 AND pos < least(9, n)) OR (pos >= 2 * n - least(9, n) AND pos < 2 * n - 2 AND n > 2)""")
def span_ranks(spark, sf):
    _, suffixes, sizes = _both(spark, sf)
    spans = sizes.select("item_id", F.lit("head").alias("span"), F.lit(2).cast("long").alias("st"), F.least(F.lit(9), F.col("size") / 2).cast("long").alias("en"))
    out = T.span_ranks(spans, suffixes, sizes, "item_id")
    return out.select("item_id", "span", F.col("rank").cast("long").alias("rank"))


@query("SELECT 's' || l_suppkey % 5 AS rf, l_partkey AS st, l_partkey + 22 AS en, CAST(l_linenumber AS BIGINT) AS evt, l_orderkey AS path, l_suppkey AS cluster, l_linestatus = 'O' AS is_fwd FROM lineitem")
def seed_dump(spark, sf):
    """Seed lines written and parsed."""
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")), s("l_partkey"), (F.col("l_partkey") + 22).cast("string"), F.concat_ws(":", s("l_linenumber"), s("l_orderkey"), s("l_suppkey")), F.when(F.col("l_linestatus") == "O", "+").otherwise("-"))
    return readers.parse_seeds(A.table(spark, sf, "lineitem").select(line.alias("value")))


@query("SELECT event_id AS id, CAST(round_even(value * 4000 * 0.75, 0) AS BIGINT) AS samples, round(1.25 * value + 3, 4) AS normed, substr('ACGTTGCAACGGTTCA', event_id % 9 + 1, 5) AS part FROM events")
def signal_scalars(spark, sf):
    e = A.table(spark, sf, "events")
    part = F.substr(F.lit("ACGTTGCAACGGTTCA"), (F.col("event_id") % 9 + 1).cast("int"), F.lit(5))
    return e.select(F.col("event_id").alias("id"), S.seconds_to_samples(F.col("value"), 0.75).alias("samples"), F.round(1.25 * F.col("value") + 3, 4).alias("normed"), part.alias("part"))


@query()
def mux_scans(spark, sf):
    """Scans among blocks of reads that go through muxes 1 to 4."""
    n = A.table(spark, sf, "nation")
    return runprofile.mux_scans(n.select((F.col("n_nationkey") * 10).alias("st"), (F.col("n_nationkey") * 10 + 3).alias("en"), (F.col("n_nationkey") % 4 + 1).alias("mux")))


@query()
def channel_timeline(spark, sf):
    """The simulator's timeline of each channel, made of the gaps and lengths of its reads."""
    s = A.summary(spark, sf).select("channel", "st", ((F.col("en") - F.col("st")) / 1e6).alias("len"), (F.col("read_id") % 5 + 1).cast("double").alias("gap"))
    c = s.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("st", "len", "gap"))).alias("r"))
    halves = F.array(*[F.struct(F.lit(a).alias("st"), F.lit(b).alias("en")) for a, b in ((0.0, 400.0), (500.0, 900.0))])
    return simulate.timeline(c.select("channel", halves.alias("intervals"), F.transform("r", lambda x: x["gap"]).alias("gaps"), F.transform("r", lambda x: x["len"]).alias("lengths")))


@query()
def preset_search(spark, sf):
    """Presets for two targets, from how match counts fall over the items."""
    k = np.arange(1024)
    mean, stdv = 60 + (k * 389 % 1024) * (60 / 1024), 1.5 + k % 7 / 10
    return presets.search_presets(A.items(spark, sf), "item_id", mean, stdv, {"default": {"speed": 115.0}, "sure": {"prob": 0.5}})


@query()
def warped_spans(spark, sf):
    """Whole signals warped onto whole items, on both strands."""
    from strandflow.operators.dtw import warp_reads

    reads, refs = A.reads(spark, sf), A.items(spark, sf).select(F.col("item_id").cast("string").alias("name"), "seq")
    n = A.table(spark, sf, "benchmark").agg(F.max("item_id") + 1).first()[0] or 1
    queries = reads.select(F.col("read_id").cast("string").alias("rd_name"), F.lit(0).alias("rd_st"), F.lit(0).alias("rd_en"), (F.col("read_id") % n).cast("string").alias("rf_name"), F.lit(0).alias("rf_st"), F.lit(1 << 30).alias("rf_en"), F.when(F.col("read_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    levels = 60 + (np.arange(1024) * 389 % 1024) * (60 / 1024)
    return warp_reads(reads, queries, refs, levels, by_event=False)
