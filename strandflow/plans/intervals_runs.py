"""Queries over intervals, run profiles, clusters and the live loop."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import curves
from strandflow.functions import intervals as V
from strandflow.operators import paths, presets, simulate
from strandflow.operators import runprofile as R
from strandflow.plans import adapters as A
from strandflow.plans.adapters import BED, SUMMARY, query
from strandflow.sources import chunks
from strandflow.streaming import realtime


def _islands(by: str, st: str, en: str, gap: str, src: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY {st}, {en} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"f AS (SELECT *, CASE WHEN {st} - max({en}) OVER {w} <= {gap} THEN 0 ELSE 1 END AS nw FROM {src}), g AS (SELECT *, sum(nw) OVER (PARTITION BY {by} ORDER BY {st}, {en} ROWS UNBOUNDED PRECEDING) AS isl FROM f)"


@query(f"WITH {BED}, {_islands('chrom', 'st', 'en', '0', 'bed')} SELECT chrom, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY chrom, isl")
def bed_merge(spark, sf):
    return V.merge(A.bed(spark, sf), ["chrom"], "st", "en", width=500)


@query(f"WITH {BED}, {_islands('chrom', 'st', 'en', '0', 'bed')}, m AS (SELECT chrom, min(st) AS st, max(en) AS en FROM g GROUP BY chrom, isl) SELECT chrom, CAST(sum(en - st) AS BIGINT) AS bp FROM m GROUP BY chrom")
def masked_bases(spark, sf):
    return V.merge(A.bed(spark, sf), ["chrom"], "st", "en", width=500).groupBy("chrom").agg(F.sum(F.col("en") - F.col("st")).alias("bp"))


_PAIR = "p AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_partkey % 50 AS a1, l_partkey % 50 + CAST(l_quantity AS BIGINT) AS a2, l_suppkey % 60 AS b1, l_suppkey % 60 + l_linenumber * 5 - 6 AS b2 FROM lineitem), v AS (SELECT *, a1 <= a2 AND b1 <= b2 AND a1 <= b2 AND b1 <= a2 AS meet FROM p)"


@query(f"""WITH {_PAIR} SELECT id, a1, b1, a2, b2, CASE WHEN b1 <= b2 THEN b2 - b1 + 1 ELSE 0 END AS len_b, meet, CASE WHEN meet THEN greatest(a1, b1) END AS i1, CASE WHEN meet THEN least(a2, b2) END AS i2, CASE WHEN meet THEN least(a1, b1) END AS h1, CASE WHEN meet THEN greatest(a2, b2) END AS h2,
round(CASE WHEN meet THEN (least(a2, b2) - greatest(a1, b1) + 1) / (greatest(a2, b2) - least(a1, b1) + 1) ELSE 0 END, 4) AS reciprocal, CAST(CASE WHEN NOT meet THEN CASE WHEN a1 <= a2 THEN 1 ELSE 0 END ELSE CAST(a1 < b1 AS INT) + CAST(a2 > b2 AS INT) END AS BIGINT) AS pieces FROM v""")
def interval_functions(spark, sf):
    li = A.table(spark, sf, "lineitem")
    p = li.select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("a1"), (F.col("l_partkey") % 50 + F.col("l_quantity").cast("long")).alias("a2"), (F.col("l_suppkey") % 60).alias("b1"), (F.col("l_suppkey") % 60 + F.col("l_linenumber") * 5 - 6).alias("b2"))
    a, b = (F.col("a1"), F.col("a2")), (F.col("b1"), F.col("b2"))
    i, h = V.intersection(a, b), V.hull(a, b)
    return p.select("id", "a1", "b1", "a2", "b2", V.length(*b).alias("len_b"), V.intersects(a, b).alias("meet"), i[0].alias("i1"), i[1].alias("i2"), h[0].alias("h1"), h[1].alias("h2"), F.round(V.reciprocal_overlap(a, b), 4).alias("reciprocal"), F.size(V.split(a, b)).cast("long").alias("pieces"))


@query("""WITH p AS (SELECT l_suppkey AS kmer, l_partkey AS st, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS en FROM lineitem), x AS (SELECT *, max(en) OVER (PARTITION BY kmer ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
g AS (SELECT kmer, coalesce(reach + 1, 0) AS gap_st, st - 1 AS gap_en FROM x UNION ALL SELECT kmer, max(en) + 1, 30000 FROM p GROUP BY kmer) SELECT kmer, gap_st, gap_en FROM g WHERE gap_st <= gap_en""")
def range_gaps(spark, sf):
    """The parts of each k-mer's range [0, 30000] that no path's range covers."""
    p = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("kmer"), F.col("l_partkey").alias("st"), (F.col("l_partkey") + F.col("l_quantity").cast("long") - 1).alias("en"), F.lit(0).cast("long").alias("lo"), F.lit(30000).cast("long").alias("hi"))
    return V.gaps(p, ["kmer"], "st", "en", "lo", "hi")


@query("SELECT l_partkey AS lo, l_suppkey AS hi, l_orderkey AS path, l_extendedprice AS prob FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def path_dedupe(spark, sf):
    """Of paths with one range the likeliest."""
    p = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("lo"), F.col("l_suppkey").alias("hi"), F.col("l_orderkey").alias("path"), F.col("l_extendedprice").alias("prob"), "l_linenumber")
    return paths.likeliest(p, ["lo", "hi"], "prob", ["path", "l_linenumber"]).drop("l_linenumber")


@query("""WITH k AS (SELECT p_partkey AS kmer, p_retailprice AS prob FROM part), used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) SELECT kmer, prob FROM k WHERE prob >= 950 AND kmer NOT IN (SELECT l_partkey FROM used)""")
def fresh_sources(spark, sf):
    """K-mers that pass the source threshold and have no path."""
    used = A.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("kmer"))
    return paths.fresh_sources(A.table(spark, sf, "part").select(F.col("p_partkey").alias("kmer"), F.col("p_retailprice").alias("prob")), used, 950)


@query("""WITH c AS (SELECT l_orderkey AS read_id, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rk FROM lineitem),
g AS (SELECT read_id, count(*) AS n, max(len) AS top, max(CASE WHEN rk = 2 THEN len END) AS second, avg(len) AS mean FROM c GROUP BY read_id) SELECT read_id, top, second, n >= 2 AND top >= 25 AND (top / mean >= 6.0 OR top / second >= 1.85) AS confident FROM g""")
def seed_confidence(spark, sf):
    """Whether a read's longest cluster stands out from the mean or from the second."""
    g = paths.top_two(A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_quantity").cast("long").alias("len")), "read_id", "len")
    return g.select("read_id", "top", "second", paths.confident(F.col("n"), F.col("top"), F.col("second"), F.col("mean")).alias("confident"))


@query("""WITH s AS (SELECT user_id AS read_id, event_id AS seed, CAST(floor(value * 10) AS BIGINT) AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 12 AS e FROM events), p AS (SELECT b.read_id, b.seed, a.seed AS prev, b.r - a.r AS dr, b.e - a.e AS de FROM s a JOIN s b ON a.read_id = b.read_id AND a.e < b.e AND b.r - a.r BETWEEN 0 AND b.e - a.e AND b.r - a.r >= (b.e - a.e) // 12)
SELECT read_id, seed, arg_max(prev, (-de, prev)) AS prev, count(*) AS n FROM p GROUP BY read_id, seed""")
def band_join_seeds(spark, sf):
    """Each seed with the latest earlier one that lies in its band of place against event, by bins of place."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = A.table(spark, sf, "events").select(F.col("user_id").alias("read_id"), F.col("event_id").alias("seed"), F.floor(F.col("value") * 10).alias("r"), (F.row_number().over(w) * 12).cast("long").alias("e"))
    longest = s.agg(F.max("e")).first()[0] or 1
    return paths.earlier_seeds(s, longest)


@query(f"WITH {SUMMARY} SELECT channel, read_id, coalesce(lag(en) OVER w, 0) AS gap_st, st - coalesce(lag(en) OVER w, 0) AS gap_len FROM summ WINDOW w AS (PARTITION BY channel ORDER BY st, read_id)")
def channel_gaps(spark, sf):
    return R.channel_gaps(A.summary(spark, sf))


@query(f"WITH {SUMMARY}, g AS (SELECT channel, read_id, st - coalesce(lag(en) OVER w, 0) AS gap_len FROM summ WINDOW w AS (PARTITION BY channel ORDER BY st, read_id)), l AS (SELECT channel, median(gap_len) + stddev_pop(gap_len) AS lim FROM g GROUP BY channel) SELECT channel, count(*) AS n FROM g JOIN l USING (channel) WHERE gap_len >= lim GROUP BY channel")
def long_gaps(spark, sf):
    return R.long_gaps(R.channel_gaps(A.summary(spark, sf))).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SUMMARY} SELECT c AS channel, count(read_id) AS n FROM range(1, 513) AS r(c) LEFT JOIN summ ON channel = c GROUP BY c")
def channel_counts(spark, sf):
    return R.channel_counts(A.summary(spark, sf), 512)


@query(f"WITH {SUMMARY}, n AS (SELECT c AS channel, count(read_id) AS n FROM range(1, 513) AS r(c) LEFT JOIN summ ON channel = c GROUP BY c) SELECT channel, n, row_number() OVER (ORDER BY n, channel) AS place FROM n")
def channel_ranks(spark, sf):
    return R.rank_channels(channel_counts(spark, sf))


@query(f"WITH {SUMMARY}, c AS (SELECT channel, mux, count(*) AS n FROM summ GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, mux DESC) AS k, sum(n) OVER (PARTITION BY channel) AS total FROM c) SELECT channel, mux, round(n / total, 4) AS share, n / total >= 0.95 AS dominant FROM r WHERE k = 1")
def mux_majority(spark, sf):
    return R.mux_majority(A.summary(spark, sf))


@query(f"WITH {SUMMARY}, {_islands('channel', 'st', 'en', '3600000000', 'summ')} SELECT channel, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY channel, isl")
def read_blocks(spark, sf):
    """Blocks of reads with pauses of at most an hour."""
    return R.blocks(A.summary(spark, sf), 3_600_000_000)


@query(f"WITH {SUMMARY}, g AS (SELECT channel, read_id, coalesce(lag(en) OVER w, 0) AS gap_st, st - coalesce(lag(en) OVER w, 0) AS gap_len FROM summ WINDOW w AS (PARTITION BY channel ORDER BY st, read_id)), f AS (SELECT *, sum(CASE WHEN gap_len >= 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY gap_st, read_id) AS part FROM g) SELECT channel, CAST(part AS BIGINT) AS part, min(gap_st + gap_len) AS st, max(gap_st) AS en, count(*) AS n FROM f GROUP BY channel, part")
def channel_activity(spark, sf):
    return R.activity(R.channel_gaps(A.summary(spark, sf)), 86_400_000_000)


@query(f"WITH {SUMMARY}, lim AS (SELECT min(st) + 86400000000 AS lo, max(en) - 86400000000 AS hi FROM summ) SELECT read_id, channel, st, en FROM summ, lim WHERE st >= lo AND en <= hi")
def reads_in_time(spark, sf):
    s = A.summary(spark, sf)
    lo, hi = s.agg(F.min("st") + 86_400_000_000, F.max("en") - 86_400_000_000).first()
    return R.in_time(s, lo, hi).select("read_id", "channel", "st", "en")


_SCANS = "sc AS (SELECT min(st) + d * 86400000000 AS a, min(st) + d * 86400000000 + 7200000000 AS b FROM summ, range(1, 4) AS r(d) GROUP BY d)"


@query(f"WITH {SUMMARY}, {_SCANS}, j AS (SELECT channel, read_id, st, en, coalesce(bool_or(st >= a AND en <= b), FALSE) AS gone, CAST(coalesce(sum(CASE WHEN NOT (st >= a AND en <= b) THEN b - a END), 0) AS BIGINT) AS shift FROM summ LEFT JOIN sc ON a <= st AND a <= en GROUP BY ALL) SELECT channel, read_id, st - shift AS st, en - shift AS en FROM j WHERE NOT gone")
def scans_removed(spark, sf):
    s = A.summary(spark, sf)
    lo = s.agg(F.min("st").alias("lo"))
    scans = lo.select(F.explode(F.array(*[F.struct((F.col("lo") + d * 86_400_000_000).alias("scan_st"), (F.col("lo") + d * 86_400_000_000 + 7_200_000_000).alias("scan_en")) for d in (1, 2, 3)])).alias("x")).select("x.*")
    return R.remove_scans(s, scans)


def _alloc(total: str, least: int) -> str:
    return f"""n AS (SELECT user_id AS channel, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, {total} * (n / (SELECT sum(n) FROM n)) - {least} AS remain FROM n), o AS (SELECT *, greatest(remain, 0) AS ov FROM s), t AS (SELECT *, CAST(round_even(coalesce({least} + (SELECT sum(remain) FROM o) * ov / (SELECT nullif(sum(ov), 0) FROM o), remain + {least}), 0) AS BIGINT) AS target FROM o),
e AS (SELECT *, {total} - (SELECT sum(target) FROM t) AS err, row_number() OVER (ORDER BY channel DESC) AS back FROM t), a AS (SELECT channel, n, target + CASE WHEN back <= abs(err) THEN CAST(sign(err) AS BIGINT) ELSE 0 END AS target FROM e)"""


_ALLOC, _EVEN = _alloc("5000", 20), _alloc("(SELECT count(*) FROM events)", 62)


def _targets(spark, sf, total: int, least: int):
    n = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return R.allocation(n, total, least)


@query(f"WITH {_ALLOC} SELECT channel, n, CAST(target AS BIGINT) AS target FROM a")
def alloc_targets(spark, sf):
    return _targets(spark, sf, 5000, 20)


@query(f"""WITH {_EVEN}, x AS (SELECT channel, n - target AS more, unnest(range(1, n - target + 1)) AS k FROM a WHERE n > target), y AS (SELECT channel, unnest(range(1, target - n + 1)) AS k FROM a WHERE n < target),
p AS (SELECT row_number() OVER (ORDER BY more DESC, channel, k) AS slot, channel AS from_channel FROM x), q AS (SELECT row_number() OVER (ORDER BY channel, k) AS slot, channel AS to_channel FROM y) SELECT slot, from_channel, to_channel FROM p JOIN q USING (slot)""")
def donated_reads(spark, sf):
    """Reads over the targets of channels go to channels under theirs; all reads are dealt out, 62 at least to each channel."""
    return R.donate(_targets(spark, sf, A.table(spark, sf, "events").count(), 62)).select(F.col("slot").cast("long").alias("slot"), "from_channel", "to_channel")


@query("""WITH k AS (SELECT n_nationkey AS x, n_nationkey * n_nationkey / 10 AS y FROM nation), q AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_quantity / 2 AS x FROM lineitem), j AS (SELECT id, ln, q.x, (SELECT max(k.x) FROM k WHERE k.x <= q.x) AS x0, (SELECT min(k.x) FROM k WHERE k.x >= q.x) AS x1 FROM q)
SELECT id, ln, round(CASE WHEN x1 IS NULL THEN k0.y WHEN x0 IS NULL THEN k1.y WHEN x0 = x1 THEN k0.y ELSE k0.y + (k1.y - k0.y) * (j.x - x0) / (x1 - x0) END, 4) AS y FROM j LEFT JOIN k k0 ON k0.x = x0 LEFT JOIN k k1 ON k1.x = x1""")
def interpolated(spark, sf):
    """Linear interpolation between knots, held at the ends."""
    knots = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("x"), (F.col("n_nationkey") * F.col("n_nationkey") / 10).alias("y"))
    q = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (F.col("l_quantity") / 2).alias("x"))
    return curves.interpolate(q, "x", knots).select("id", "ln", F.round("y", 4).alias("y"))


@query("SELECT s_suppkey AS id, i, round(0.5 + pow(i / 99, 2.5) * (s_nationkey / 50), 6) AS y FROM supplier, range(100) AS r(i)")
def power_curve(spark, sf):
    """A curve of a hundred steps for each supplier."""
    df = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("i"))
    return df.select("id", "i", F.round(curves.power_curve(F.col("i") / 99, F.lit(0.5), 0.5 + F.col("s_nationkey") / 50, 2.5), 6).alias("y"))


@query("SELECT l_returnflag AS preset, round(exp(sum(ln(1 - l_tax / 1000))), 6) AS prob, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS speed FROM lineitem GROUP BY 1")
def preset_speed(spark, sf):
    """A preset's overall probability (a product) and speed (a weighted mean)."""
    li = A.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("preset"), (1 - F.col("l_tax") / 1000).alias("share"), F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("matches"))
    return presets.overall(li, "preset").select("preset", F.round("prob", 6).alias("prob"), F.round("speed", 4).alias("speed"))


@query(f"WITH {SUMMARY}, l AS (SELECT channel, arg_max(mux, (st, read_id)) AS mux FROM summ GROUP BY channel), n AS (SELECT mux, count(*) AS n FROM l GROUP BY mux), t AS (SELECT mux, n, (SELECT sum(n) FROM n WHERE mux <> 0) AS used FROM n ORDER BY n DESC, mux DESC LIMIT 1) SELECT mux, round(n / used, 4) AS share, n / used > 0.99 AS scanning FROM t")
def scan_detection(spark, sf):
    return realtime.scan_detect(A.summary(spark, sf))


@query("WITH c AS (SELECT user_id AS channel, event_id AS number, epoch_us(ts) AS st FROM events), e AS (SELECT channel, number, st - CASE WHEN number % 2 = 0 THEN 1 ELSE -1 END AS upto FROM c WHERE channel % 2 = 0) SELECT channel, number, st AS start_sample FROM c JOIN e USING (channel, number) WHERE st > upto")
def late_chunks(spark, sf):
    c = A.table(spark, sf, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("number"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_sample"))
    e = c.filter(realtime.channel_parity(F.col("channel"), "even")).select("channel", "number", (F.col("start_sample") - F.when(F.col("number") % 2 == 0, 1).otherwise(-1)).alias("at"))
    return realtime.late_chunks(c, e)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1")
def tumbling_windows(spark, sf):
    return realtime.tumbling(A.table(spark, sf, "events"), "ts", "1 day").select(F.col("st").cast("timestamp_ntz").alias("day"), "n")


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(ts) AS st, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark, sf):
    return realtime.sessions(A.table(spark, sf, "events"), "ts", "user_id", "6 hours").select("user_id", F.col("st").cast("timestamp_ntz").alias("st"), "n")


@query()
def channel_outcomes(spark, sf):
    """Read outcomes of the live loop over chunks made from the vectors' signals."""
    r = A.reads(spark, sf).withColumns({"number": F.col("read_id"), "start_sample": F.col("read_id") * 64})
    return realtime.run_channels(chunks.from_reads(r, 16), simulate.made_mapper, "made", max_chunks=3)


@query(f"WITH {SUMMARY}, b AS (SELECT DISTINCT (st // 43200000000) * 43200000000 AS bound FROM summ), sp AS (SELECT row_number() OVER (ORDER BY bound) - 1 AS scan, bound AS lo, lead(bound) OVER (ORDER BY bound) AS hi FROM b), g AS (SELECT channel, read_id, coalesce(lag(en) OVER w, 0) AS gap_st, st - coalesce(lag(en) OVER w, 0) AS gap_len FROM summ WINDOW w AS (PARTITION BY channel ORDER BY st, read_id)) SELECT channel, read_id, scan FROM g JOIN sp ON gap_st > lo AND gap_st + gap_len <= hi")
def gaps_in_scans(spark, sf):
    """Gaps by the half day that holds them whole."""
    s = A.summary(spark, sf)
    half = F.lit(43_200_000_000)
    bounds = s.select((F.floor(F.col("st") / half) * half).alias("bound")).distinct()
    return R.gaps_by_scan(R.channel_gaps(s), bounds).select("channel", "read_id", F.col("scan").cast("long").alias("scan"))


@query("WITH i AS (SELECT s_suppkey AS channel, r.i AS i, CAST(0 AS DOUBLE) AS st, CAST(s_nationkey + r.i AS DOUBLE) AS en FROM supplier, range(4) AS r(i)), m AS (SELECT i, max(en - st) AS long FROM i GROUP BY i), b AS (SELECT i, coalesce(sum(long) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (row_number() OVER (ORDER BY i) - 1) * 90 AS begin FROM m) SELECT channel, i, begin AS st, begin + en - st AS en FROM i JOIN b USING (i)")
def scan_pauses(spark, sf):
    """Four rounds of active intervals a channel, with a scan of 90 seconds after each."""
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("channel"), "s_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("i"))
    return R.scan_pauses(s.select("channel", "i", F.lit(0.0).alias("st"), (F.col("s_nationkey") + F.col("i")).cast("double").alias("en")), 90.0)


@query("SELECT CAST(floor(event_id / 100) AS BIGINT) AS tick, user_id % 4 AS worker, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def active_reads(spark, sf):
    return realtime.active_reads(A.table(spark, sf, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("start_sample")), 4, 100)


@query("SELECT CAST(l_linenumber AS BIGINT) AS evt, 's' || (l_suppkey % 5) AS rf, max(CAST(l_quantity AS BIGINT)) AS length FROM lineitem GROUP BY 1, 2")
def longest_paths(spark, sf):
    p = A.table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("evt"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("rf"), F.col("l_quantity").cast("long").alias("length"))
    return paths.longest_paths(p)


@query()
def warped_signals(spark, sf):
    """Warping of neighbouring signals onto each other."""
    from strandflow.operators.dtw import EVENT_COLUMNS, align

    r = A.reads(spark, sf)
    other = r.select((F.col("read_id") - 1).alias("o"), F.col("signal").alias("levels"))
    return align(r.join(other, F.col("read_id") == F.col("o")).select(F.col("read_id").alias("id"), "signal", "levels"), EVENT_COLUMNS)
