"""Queries over alignment records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandflow.operators import pafstats, yields
from strandflow.plans import adapters as A
from strandflow.plans.adapters import BED, PAF, query

_EXT = """greatest(rf_st - CASE WHEN is_fwd THEN CAST(trunc(1.5 * qr_st) AS BIGINT) ELSE CAST(trunc(1.5 * (qr_len - qr_en)) AS BIGINT) END, 1) AS x_st,
  least(rf_en + CASE WHEN is_fwd THEN CAST(trunc(1.5 * (qr_len - qr_en)) AS BIGINT) ELSE CAST(trunc(1.5 * qr_st) AS BIGINT) END, rf_len) AS x_en"""
_CLASSES = f"""WITH {PAF}, e AS (SELECT *, {_EXT} FROM paf), c AS (SELECT * FROM e WHERE rn = 1),
t AS (SELECT e.* FROM e JOIN orders ON o_orderkey = qr_name WHERE rn > 1 AND o_orderstatus <> 'P'),
g AS (SELECT c.qr_name, c.is_mapped, coalesce(bool_or(c.is_mapped AND t.is_mapped AND starts_with(c.rf_name, t.rf_name) AND c.x_st <= t.x_en AND t.x_st <= c.x_en), FALSE) AS hit,
  coalesce(arg_min(t.is_mapped, t.rn), FALSE) AS first FROM c LEFT JOIN t ON t.qr_name = c.qr_name GROUP BY 1, 2),
k AS (SELECT qr_name, CASE WHEN is_mapped THEN CASE WHEN NOT first THEN 'na' WHEN hit THEN 'tp' ELSE 'fp' END WHEN first THEN 'fn' ELSE 'tn' END AS cls FROM g)"""


def _classified(spark, sf):
    paf = A.paf(spark, sf)
    known = A.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qr_name"))
    return pafstats.classify(paf.filter("rn = 1"), paf.filter("rn > 1").join(known, "qr_name", "left_semi"))


@query(_CLASSES + " SELECT cls, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM k), 4) AS pct FROM k GROUP BY cls")
def paf_confusion(spark, sf):
    return pafstats.confusion(_classified(spark, sf))


@query(_CLASSES + " SELECT qr_name, cls FROM k")
def paf_classes(spark, sf):
    return _classified(spark, sf)


@query(f"WITH {PAF}, m AS (SELECT 1000 * qr_en / mt AS bps, CAST(qr_en AS DOUBLE) AS bp, mt AS ms FROM paf WHERE rn = 1 AND is_mapped) SELECT avg(bps) AS mean_bps, median(bps) AS median_bps, avg(bp) AS mean_bp, median(bp) AS median_bp, avg(ms) AS mean_ms, median(ms) AS median_ms FROM m")
def map_speed_stats(spark, sf):
    return pafstats.speed(A.paf(spark, sf).filter("rn = 1"))


@query(f"WITH {PAF} SELECT count(*) AS n, CAST(count_if(is_mapped) AS BIGINT) AS mapped, round(100 * count_if(is_mapped) / count(*), 4) AS pct FROM paf WHERE rn = 1")
def mapped_share(spark, sf):
    return A.paf(spark, sf).filter("rn = 1").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_mapped")).alias("mapped"), F.round(100 * F.count_if(F.col("is_mapped")) / F.count(F.lit(1)), 4).alias("pct"))


@query(f"WITH {PAF} SELECT qr_name, rn, {_EXT} FROM paf")
def extended_span(spark, sf):
    st, en = pafstats.extended_span()
    return A.paf(spark, sf).select("qr_name", "rn", st.alias("x_st"), en.alias("x_en"))


_LINE = """CASE WHEN is_mapped THEN concat_ws(chr(9), qr_name, qr_len, qr_st, qr_en, CASE WHEN is_fwd THEN '+' ELSE '-' END, rf_name, rf_len, rf_st, rf_en, 200, 201, 255)
  ELSE concat_ws(chr(9), qr_name, qr_len, '*', '*', '*', '*', '*', '*', '*', '*', '*', 255) END"""


def _lines(spark, sf):
    df = A.paf(spark, sf).withColumn("match_num", F.lit(200))
    return df.select("qr_name", "rn", pafstats.format_line().alias("line"), F.concat(pafstats.format_line(), F.lit("\tmt:f:"), F.col("rn").cast("string"), F.lit("\tqt:Z:a:b")).alias("tagged"))


@query(f"WITH {PAF} SELECT qr_name, rn, {_LINE} AS line FROM paf")
def paf_format(spark, sf):
    return _lines(spark, sf).select("qr_name", "rn", "line")


@query(f"WITH {PAF} SELECT CAST(qr_name AS VARCHAR) AS qr_name, qr_len, CASE WHEN is_mapped THEN qr_st END AS qr_st, CASE WHEN is_mapped THEN rf_name END AS rf_name, CASE WHEN is_mapped THEN rf_en END AS rf_en, is_mapped, CAST(rn AS VARCHAR) AS mt, 'a:b' AS qt FROM paf")
def paf_round_trip(spark, sf):
    """Records to tagged text lines and back."""
    parsed = pafstats.parse(_lines(spark, sf).select(F.col("tagged").alias("value")))
    return parsed.select("qr_name", "qr_len", "qr_st", "rf_name", "rf_en", "is_mapped", pafstats.tag("mt").alias("mt"), pafstats.tag("qt").alias("qt"))


@query(f"WITH {PAF} SELECT CAST(rf_name AS VARCHAR) AS qr_name, CAST(qr_name AS VARCHAR) AS rf_name, rf_st AS qr_st, qr_st AS rf_st, rf_en AS qr_en, qr_en AS rf_en FROM paf WHERE is_mapped")
def paf_swap(spark, sf):
    df = A.paf(spark, sf).filter("is_mapped").select(F.col("qr_name").cast("string").alias("qr_name"), "rf_name", "qr_len", "rf_len", "qr_st", "rf_st", "qr_en", "rf_en")
    return pafstats.swap_roles(df).select("qr_name", "rf_name", "qr_st", "rf_st", "qr_en", "rf_en")


@query("""WITH c AS (SELECT l_orderkey AS id, l_partkey * 4 AS ref_st, l_partkey * 4 + CAST(l_quantity AS BIGINT) AS ref_en, CAST(l_quantity AS BIGINT) AS total_len, CAST(9000 AS BIGINT) AS size FROM lineitem)
SELECT id, ref_st < size / 2 AS is_fwd, CASE WHEN ref_st < size / 2 THEN ref_st ELSE size - (ref_en + 4) END AS rf_st, CASE WHEN ref_st < size / 2 THEN ref_st ELSE size - (ref_en + 4) END + ref_en - ref_st + 5 AS rf_en, total_len + 4 AS matches FROM c""")
def cluster_location(spark, sf):
    q = F.col("l_quantity").cast("long")
    c = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 4).alias("ref_st"), (F.col("l_partkey") * 4 + q).alias("ref_en"), q.alias("total_len"), F.lit(9000).cast("long").alias("size"))
    return pafstats.locate(c, "size").select("id", "is_fwd", "rf_st", "rf_en", "matches")


#: A run's summary and the tagged calls of its reads, made from orders and their first lines.
_RUN = f"""{PAF}, s AS (SELECT o_orderkey AS read_id, o_totalprice / 1000 AS duration, o_custkey % 10 / 10 AS template_start, o_totalprice / 1000 + 0.5 AS template_duration, o_custkey * 3 + 100 AS bases FROM orders),
c AS (SELECT qr_name, qr_len, rf_st AS st, CASE WHEN is_fwd THEN qr_st / 10 END AS ej, CASE WHEN rf_st % 2 = 0 THEN qr_st * 100 END AS dl FROM paf WHERE rn = 1)"""


def _summary(spark, sf):
    total = F.col("o_totalprice") / 1000
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), total.alias("duration"), (F.col("o_custkey") % 10 / 10).alias("template_start"), (total + 0.5).alias("template_duration"), (F.col("o_custkey") * 3 + 100).alias("bases"))


def _tagged(df):
    none = F.create_map().cast("map<string,struct<type:string,value:string>>")
    tags = pafstats.set_tag(none, "st", F.col("rf_st"), "i")
    tags = pafstats.set_tag(tags, "ej", F.when(F.col("is_fwd"), F.col("qr_st") / 10), "f")
    tags = pafstats.set_tag(tags, "dl", F.when(F.col("rf_st") % 2 == 0, F.col("qr_st") * 100), "i")
    return df.withColumn("tags", pafstats.set_tag(tags, "tp", F.when(F.col("rn") % 3 != 0, F.lit("P")), "Z"))


@query(f"WITH {_RUN} SELECT read_id, round(CASE WHEN ej IS NOT NULL THEN greatest(0, duration - template_start - (qr_len / 450 + ej)) END, 6) AS delay FROM s LEFT JOIN c ON qr_name = read_id")
def eject_delay(spark, sf):
    """Seconds between an ejected read's decision and its end, never under 0."""
    return yields.eject_delays(_summary(spark, sf), _tagged(A.paf(spark, sf).filter("rn = 1"))).select("read_id", F.round("delay", 6).alias("delay"))


@query(f"WITH {_RUN}, d AS (SELECT greatest(0, duration - template_start - (qr_len / 450 + ej)) AS delay FROM s JOIN c ON qr_name = read_id WHERE ej IS NOT NULL) SELECT count(*) AS ejected, round(median(delay), 6) AS median_delay FROM d")
def median_eject_delay(spark, sf):
    return yields.median_delay(yields.eject_delays(_summary(spark, sf), _tagged(A.paf(spark, sf).filter("rn = 1")))).select("ejected", F.round("median_delay", 6).alias("median_delay"))


@query(f"WITH {_RUN} SELECT round(max(st / 4000 + qr_len / 450), 6) AS seconds FROM c")
def run_seconds(spark, sf):
    return yields.run_seconds(_tagged(A.paf(spark, sf).filter("rn = 1"))).select(F.round("seconds", 6).alias("seconds"))


_NAMES = "('s1', 's3')"
_SUMS = "SELECT round({on} / 0.25, 6) AS unc_on_bp, round(({on} + {off}) / 0.25, 6) AS unc_total_bp, round(con, 6) AS cnt_on_bp, round(con + coff, 6) AS cnt_total_bp FROM ctl, unc"


def _genome(name: str, deplete: bool) -> str:
    return f"""WITH {_RUN}, t AS (SELECT DISTINCT qr_name FROM paf WHERE rn > 1 AND rn % 3 <> 0 AND is_mapped AND rf_name {'NOT IN' if deplete else 'IN'} {_NAMES}), x AS (SELECT s.*, t.qr_name IS NOT NULL AS target FROM s LEFT JOIN t ON t.qr_name = read_id),
ctl AS (SELECT sum(CASE WHEN target THEN bases ELSE 0 END) / 1e6 AS con, sum(CASE WHEN target THEN 0 ELSE bases END) / 1e6 AS coff FROM x),
g AS (SELECT target, CASE WHEN ej IS NULL THEN bases ELSE least(bases, bases / template_duration * (qr_len / 450 + coalesce(dl, 0) / 4000 + ej - template_start)) END AS got FROM x JOIN c ON c.qr_name = read_id),
unc AS (SELECT sum(CASE WHEN target THEN got ELSE 0 END) / 1e6 AS uon, sum(CASE WHEN target THEN 0 ELSE got END) / 1e6 AS uoff FROM g) """ + _SUMS.format(on="uon", off="uoff")


def _yield(spark, sf, deplete: bool):
    paf, calls = A.paf(spark, sf), A.paf(spark, sf).filter("rn = 1")
    names = A.table(spark, sf, "region").filter("r_regionkey IN (1, 3)").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("name"))
    targets = yields.target_reads(_tagged(paf.filter("rn > 1")), names, deplete)
    out = yields.genome_yield(_summary(spark, sf), _tagged(calls), targets, 0.25)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(_genome("genome_yield", False))
def genome_yield(spark, sf):
    """Millions of bases on target and in all, of the run and its control; targets by a read's primary alignments."""
    return _yield(spark, sf, False)


@query(_genome("depletion_yield", True))
def depletion_yield(spark, sf):
    return _yield(spark, sf, True)


@query(f"""WITH {_RUN}, {BED}, t AS (SELECT name, sum(en - st) AS tb FROM bed WHERE chrom % 2 = 0 GROUP BY name), x AS (SELECT s.*, coalesce(tb, 0) AS bp FROM s LEFT JOIN t ON name = read_id), ctl AS (SELECT sum(bp) / 1e6 AS con, sum(bases - bp) / 1e6 AS coff FROM x),
g AS (SELECT *, bases / template_duration * (qr_len / 450 + coalesce(dl, 0) / 4000 + ej - template_start) AS kept FROM x JOIN c ON qr_name = read_id),
unc AS (SELECT sum(CASE WHEN ej IS NULL THEN bp WHEN bp > 0 THEN kept ELSE 0 END) / 1e6 AS uon, sum(CASE WHEN ej IS NULL THEN bases - bp WHEN bp > 0 THEN 0 ELSE kept END) / 1e6 AS uoff FROM g) """ + _SUMS.format(on="uon", off="uoff"))
def bed_yield(spark, sf):
    """The same by the bases of each read that an interval list has on target."""
    out = yields.bed_yield(_summary(spark, sf), _tagged(A.paf(spark, sf).filter("rn = 1")), A.bed(spark, sf).filter("chrom % 2 = 0"), 0.25)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_RUN} SELECT qr_name, string_agg(CAST(rf_st AS VARCHAR), ',' ORDER BY rn) AS starts FROM paf GROUP BY qr_name")
def tags_by_read(spark, sf):
    """A tag's values of all records of a read, in order."""
    return pafstats.tags_by_read(_tagged(A.paf(spark, sf)), "st", "rn").select("qr_name", F.array_join("values", ",").alias("starts"))


@query(f"WITH {_RUN} SELECT qr_name, concat(CASE WHEN dl IS NULL THEN '' ELSE chr(9) || 'dl:i:' || dl END, chr(9), 'st:i:', st, chr(9), 'tp:Z:P') AS tags, st AS n FROM c WHERE ej IS NULL")
def written_tags(spark, sf):
    """Tags as text behind a line, and one read back as a number."""
    df = _tagged(A.paf(spark, sf).filter("rn = 1 AND NOT is_fwd"))
    number = pafstats.typed(pafstats.tag("st"), F.element_at("tags", "st")["type"])["i"]
    return df.select("qr_name", pafstats.format_tags(F.col("tags")).alias("tags"), number.alias("n"))


@query(f"WITH {BED} SELECT name, CAST(sum(en - st) AS BIGINT) AS bp FROM bed GROUP BY name")
def bed_bases(spark, sf):
    return A.bed(spark, sf).groupBy("name").agg(F.sum(F.col("en") - F.col("st")).alias("bp"))


@query("SELECT o_orderkey AS read_id, CASE WHEN o_orderstatus = 'F' THEN 'en' WHEN o_orderstatus = 'P' THEN CASE WHEN o_custkey % 10 = 0 THEN 'mx' ELSE 'ej' END ELSE 'kp' END AS enrich, CASE WHEN o_orderstatus = 'F' THEN 'en' WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 10 = 0 THEN 'mx' ELSE 'ej' END ELSE 'kp' END AS deplete FROM orders")
def decision(spark, sf):
    from strandflow.streaming.realtime import decide

    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), (F.col("o_orderstatus") == "F").alias("ended"), (F.col("o_orderstatus") == "O").alias("mapped"), (F.col("o_custkey") % 10 == 0).alias("in_scan"))
    cols = [F.col(c) for c in ("ended", "mapped", "in_scan")]
    return o.select("read_id", decide(*cols, mode="enrich").alias("enrich"), decide(*cols, mode="deplete").alias("deplete"))
