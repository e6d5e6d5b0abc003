"""Queries over signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandflow.functions import model as M
from strandflow.functions import signal as S
from strandflow.plans import adapters as A
from strandflow.plans.adapters import MODEL, SIGNAL, query


def _t(half: int) -> str:
    a, b = f"(PARTITION BY read_id ORDER BY i ROWS BETWEEN {half} PRECEDING AND 1 PRECEDING)", f"(PARTITION BY read_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {half - 1} FOLLOWING)"
    return f"CASE WHEN count(x) OVER {a} = {half} AND count(x) OVER {b} = {half} THEN abs(avg(x) OVER {b} - avg(x) OVER {a}) / sqrt(greatest(var_pop(x) OVER {a} + var_pop(x) OVER {b}, 1e-30) / {half}) ELSE 0 END"


@query(f"WITH {SIGNAL} SELECT read_id, i, round({_t(3)}, 4) AS t3, round({_t(6)}, 4) AS t6 FROM sig")
def signal_tstat(spark, sf):
    df = S.tstat(A.signal_long(spark, sf), 3).withColumnRenamed("t", "t3")
    return S.tstat(df, 6).select("read_id", "i", F.round("t3", 4).alias("t3"), F.round("t", 4).alias("t6"))


@query(f"WITH {SIGNAL} SELECT read_id, i, round(sum(x) OVER w, 4) AS sum_x, round(sum(x * x) OVER w, 4) AS sum_xx FROM sig WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS UNBOUNDED PRECEDING)")
def prefix_sums(spark, sf):
    return S.prefix_sums(A.signal_long(spark, sf)).select("read_id", "i", F.round("sum_x", 4).alias("sum_x"), F.round("sum_xx", 4).alias("sum_xx"))


def _mask(tail: bool) -> str:
    ahead = "CURRENT ROW AND 24 FOLLOWING" if tail else "1 FOLLOWING AND 24 FOLLOWING"
    keep = f"coalesce(min(CASE WHEN i >= 12 THEN sd END) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN {ahead}) >= 16, TRUE)"
    keep = keep if tail else f"CASE WHEN count(*) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) >= 25 THEN {keep} END"
    return f"WITH {SIGNAL}, s AS (SELECT *, stddev_pop(x) OVER (PARTITION BY read_id ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS sd FROM sig) SELECT read_id, i, {keep} AS keep FROM s"


@query(_mask(False))
def stall_mask(spark, sf):
    return S.stall_mask(A.signal_long(spark, sf), least_stdv=16.0).select("read_id", "i", "keep")


@query(_mask(True))
def stall_mask_full(spark, sf):
    return S.stall_mask(A.signal_long(spark, sf), least_stdv=16.0, tail=True).select("read_id", "i", "keep")


@query(f"SELECT read_id, i, row_number() OVER (PARTITION BY read_id ORDER BY i) - 1 AS masked_i FROM ({_mask(True)}) WHERE keep")
def mask_index(spark, sf):
    """Place of each kept event among the kept ones."""
    return S.masked_index(stall_mask_full(spark, sf))


@query(f"WITH {SIGNAL} SELECT read_id, i, round((x - avg(x) OVER w) * 12.83266 / stddev_pop(x) OVER w + 90.20827, 4) AS norm FROM sig WINDOW w AS (PARTITION BY read_id)")
def normalise_read(spark, sf):
    return S.normalise_read(A.signal_long(spark, sf), 90.20827, 12.83266).select("read_id", "i", F.round("norm", 4).alias("norm"))


@query(f"WITH {SIGNAL}, s AS (SELECT *, avg(x) OVER w AS m, stddev_pop(x) OVER w AS sd FROM sig WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT read_id, i, round(CASE WHEN i > 0 THEN (x - m) / sd * 12.83266 + 90.20827 ELSE 90.20827 END, 3) AS norm FROM s")
def normalise_rolling(spark, sf):
    return S.normalise_rolling(A.signal_long(spark, sf), 90.20827, 12.83266, 20).select("read_id", "i", F.round("norm", 3).alias("norm"))


@query(f"""WITH {SIGNAL}, {MODEL}, p AS (SELECT read_id, i, kmer, round(-(pow(x - level_mean, 2) / (2 * level_stdv * level_stdv)) - ln(sqrt(2 * pi() * level_stdv * level_stdv)), 4) AS p FROM sig, model)
SELECT read_id, i, arg_max(kmer, (p, -kmer)) AS kmer, max(p) AS p FROM p GROUP BY read_id, i""")
def event_kmer_prob(spark, sf):
    """The likeliest k-mer of every event, over the whole (1024-row) model."""
    return S.likeliest_kmer(A.signal_long(spark, sf), M.rule_model(spark))


@query(f"""WITH {SIGNAL}, {MODEL}, p AS (SELECT read_id, i, exp(-(pow(x - level_mean, 2) / (2 * level_stdv * level_stdv)) - ln(sqrt(2 * pi() * level_stdv * level_stdv))) AS d FROM sig, model)
SELECT read_id, i, round(sum(d), 6) AS density, count(*) AS n FROM p GROUP BY read_id, i""")
def event_density(spark, sf):
    """Every event's log density under every k-mer, summed up as densities."""
    df = S.event_probs(A.signal_long(spark, sf), M.rule_model(spark))
    return df.select("read_id", "i", F.round(F.aggregate("probs", F.lit(0.0), lambda t, x: t + F.exp(x)), 6).alias("density"), F.size("probs").cast("long").alias("n"))


@query(f"WITH {MODEL} SELECT round(avg(level_mean), 4) AS mean, round(stddev_pop(level_mean), 4) AS stdv FROM model")
def model_stats(spark, sf):
    return M.model_stats(M.rule_model(spark)).select(F.round("mean", 4).alias("mean"), F.round("stdv", 4).alias("stdv"))


@query("SELECT vec_id AS read_id, unnest(range(0, CAST(ceil(len(embedding) / 10) AS BIGINT))) * 10 AS st, CAST(floor(len(embedding) / 10) AS BIGINT) AS whole, CAST(least(3, ceil((len(embedding) - 15) / 10)) AS BIGINT) AS some, vec_id * 64 + len(embedding) AS ends FROM embeddings")
def chunk_layout(spark, sf):
    n = F.size("signal")
    r = A.reads(spark, sf)
    return r.select("read_id", F.explode(S.chunks(n, 10, tail=True)).alias("st"), F.size(S.chunks(n, 10, tail=False)).cast("long").alias("whole"), F.size(S.chunks(n, 10, tail=True, offset=15, most=3)).cast("long").alias("some"), S.read_end(F.col("read_id") * 64, F.col("signal")).alias("ends"))


@query("SELECT vec_id AS read_id, unnest(range(0, 64)) AS i, round(CAST(unnest(embedding) AS DOUBLE) * 5 + 10, 4) AS x FROM embeddings")
def calibrated_signal(spark, sf):
    """Samples calibrated from raw values: range * (raw + offset) / digitisation."""
    r = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("read_id"), S.calibrate(F.transform("embedding", lambda e: e.cast("double")), F.lit(2.0), F.lit(10.0), F.lit(2.0)).alias("signal"))
    return S.long_signal(r).select("read_id", "i", F.round("x", 4).alias("x"))


@query(f"""WITH {SIGNAL}, b AS (SELECT *, CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS s FROM sig), e AS (SELECT *, sum(s) OVER (PARTITION BY read_id ORDER BY i) - 1 AS evt FROM b),
g AS (SELECT read_id, CAST(evt AS BIGINT) AS evt, min(i) AS start, count(*) AS length, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS stdv FROM e GROUP BY read_id, evt)
SELECT * FROM g QUALIFY evt < max(evt) OVER (PARTITION BY read_id)""")
def materialised_events(spark, sf):
    """Events between given boundaries (here every seventh sample)."""
    df = A.signal_long(spark, sf)
    e = S.materialise_events(df, df.filter("i % 7 = 0").select("read_id", F.col("i").alias("start")))
    return e.select("read_id", "evt", "start", "length", F.round("mean", 4).alias("mean"), F.round("stdv", 4).alias("stdv"))


@query(f"WITH {SIGNAL}, m AS (SELECT read_id, avg(x) / 10 AS len FROM sig GROUP BY read_id) SELECT read_id, i, CAST(floor(i * len * 450 / 4000) AS BIGINT) AS bp, CAST(floor(i * len * 450 / 4000) AS BIGINT) + 4 AS last_bp, CAST(round_even(x * 4000 * 0.001, 0) AS BIGINT) AS samples FROM sig JOIN m USING (read_id)")
def event_positions(spark, sf):
    w = Window.partitionBy("read_id")
    df = A.signal_long(spark, sf).withColumn("len", F.avg("x").over(w) / 10)
    return df.select("read_id", "i", S.event_to_bp(F.col("i"), F.col("len"), F.lit(False)).alias("bp"), S.event_to_bp(F.col("i"), F.col("len"), F.lit(True)).alias("last_bp"), S.seconds_to_samples(F.col("x"), 0.001).alias("samples"))


@query(f"WITH {SIGNAL} SELECT read_id, CAST(i // 16 AS BIGINT) AS chunk, min(i) AS first_evt, max(i) AS last_evt FROM sig GROUP BY 1, 2")
def chunk_event_bounds(spark, sf):
    return S.chunk_bounds(A.signal_long(spark, sf), F.col("i"), 16)


@query()
def segmented_events(spark, sf):
    """Events found by the dual peak detector over whole signals."""
    from strandflow.operators.segment import segment

    df = A.signal_long(spark, sf).groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("signal"))
    return segment(df)
