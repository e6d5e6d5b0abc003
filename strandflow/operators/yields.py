"""What a selective run yields against its control: ejection delays, on-target and total bases.

``summary`` has read_id, duration, template_start (seconds after the read's start), template_duration, bases;
``calls`` are alignment records with tags (st: start sample, ej or ub: seconds to the ejection, dl: delay in samples).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.signal import BASES_PER_SECOND, SAMPLES_PER_SECOND
from strandflow.operators.pafstats import tag


def number_tag(name: str) -> Column:
    return tag(name).try_cast("double")


def eject_delays(summary: DataFrame, calls: DataFrame) -> DataFrame:
    """(read_id, delay): seconds between a read's ejection, as decided, and its end, never under 0; null for a read that was not ejected.

    The template's length in time is compared with what had been read at the decision (bases at the usual speed) and the time it took.
    """
    at = F.coalesce(number_tag("ej"), number_tag("ub"))
    c = calls.filter(at.isNotNull()).select(F.col("qr_name").cast("string").alias("_q"), (F.col("qr_len") / BASES_PER_SECOND + at).alias("_at"))
    joined = summary.join(c, F.col("read_id").cast("string") == F.col("_q"), "left")
    return joined.select("read_id", F.when(F.col("_q").isNotNull(), F.greatest(F.lit(0.0), F.col("duration") - F.col("template_start") - F.col("_at"))).alias("delay"))


def median_delay(delays: DataFrame) -> DataFrame:
    """Median of the delays of ejected reads, and their number."""
    return delays.agg(F.count("delay").alias("ejected"), F.median("delay").alias("median_delay"))


def target_reads(truth: DataFrame, references: DataFrame, deplete: bool = False) -> DataFrame:
    """Reads with a primary mapped alignment to a sequence of ``references`` (name), or, to deplete, to another."""
    primary = truth.filter(F.col("is_mapped") & (tag("tp") == "P")).select(F.col("qr_name").cast("string").alias("read_id"), "rf_name")
    names = references.select(F.col("name").alias("_n")).distinct()
    return primary.join(names, F.col("rf_name") == F.col("_n"), "left_anti" if deplete else "left_semi").select("read_id").distinct()


def target_bases(bed: DataFrame) -> DataFrame:
    """(read_id, bp): bases of each read that an interval list (st, en, name: the read) has on target."""
    return bed.groupBy(F.col("name").cast("string").alias("read_id")).agg(F.sum(F.col("en") - F.col("st")).alias("bp"))


def run_seconds(calls: DataFrame) -> DataFrame:
    """The run's length: the latest end of a read, by its start sample and its bases at the usual speed."""
    return calls.agg(F.max(number_tag("st") / SAMPLES_PER_SECOND + F.col("qr_len") / BASES_PER_SECOND).alias("seconds"))


def _kept_bases() -> Column:
    """Bases that an ejected read had given when it left: its own speed over the time to the decision, the delay and the ejection."""
    time = F.col("qr_len") / BASES_PER_SECOND + F.coalesce(number_tag("dl"), F.lit(0.0)) / SAMPLES_PER_SECOND + number_tag("ej") - F.col("template_start")
    return F.col("bases") / F.col("template_duration") * time


def _totals(rows: DataFrame, on: Column, off: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(on), F.lit(0.0)).cast("double").alias("on_bp"), F.coalesce(F.sum(off), F.lit(0.0)).cast("double").alias("off_bp"))


def _report(control: DataFrame, run: DataFrame, sim_speed: float) -> DataFrame:
    """Millions of bases; the run's are over the share of the run that was simulated. Both inputs are one row."""
    c = control.select((F.col("on_bp") / 1e6).alias("cnt_on_bp"), ((F.col("on_bp") + F.col("off_bp")) / 1e6).alias("cnt_total_bp"))
    r = run.select((F.col("on_bp") / 1e6 / sim_speed).alias("unc_on_bp"), ((F.col("on_bp") + F.col("off_bp")) / 1e6 / sim_speed).alias("unc_total_bp"))
    return r.crossJoin(F.broadcast(c))


def genome_yield(summary: DataFrame, calls: DataFrame, targets: DataFrame, sim_speed: float = 1.0) -> DataFrame:
    """One row: unc_on_bp, unc_total_bp, cnt_on_bp, cnt_total_bp. A target read counts whole; an ejected one up to its ejection, at most its length.

    The control counts every read of the summary; the run every call of a read that the summary has.
    """
    t = targets.select(F.col("read_id").alias("_t")).distinct()
    s = summary.withColumn("_id", F.col("read_id").cast("string")).join(t, F.col("_id") == F.col("_t"), "left").withColumn("on", F.col("_t").isNotNull())
    split = lambda value: (F.when(F.col("on"), value).otherwise(0.0), F.when(~F.col("on"), value).otherwise(0.0))
    own = s.join(calls.withColumn("_q", F.col("qr_name").cast("string")), F.col("_id") == F.col("_q"))
    ejected = number_tag("ej").isNotNull()
    got = F.when(ejected, F.least(F.col("bases").cast("double"), _kept_bases())).otherwise(F.col("bases").cast("double"))
    return _report(_totals(s, *split(F.col("bases").cast("double"))), _totals(own, *split(got)), sim_speed)


def bed_yield(summary: DataFrame, calls: DataFrame, bed: DataFrame, sim_speed: float = 1.0) -> DataFrame:
    """As ``genome_yield`` with the bases of each read that an interval list has on target; an ejected read counts as on target if it has any."""
    t = target_bases(bed).select(F.col("read_id").alias("_t"), F.col("bp").alias("_bp"))
    s = summary.withColumn("_id", F.col("read_id").cast("string")).join(t, F.col("_id") == F.col("_t"), "left").withColumn("bp", F.coalesce(F.col("_bp"), F.lit(0)).cast("double"))
    own = s.join(calls.withColumn("_q", F.col("qr_name").cast("string")), F.col("_id") == F.col("_q"))
    ejected, kept = number_tag("ej").isNotNull(), _kept_bases()
    on = F.when(ejected, F.when(F.col("bp") > 0, kept).otherwise(0.0)).otherwise(F.col("bp"))
    off = F.when(ejected, F.when(F.col("bp") > 0, 0.0).otherwise(kept)).otherwise(F.col("bases") - F.col("bp"))
    return _report(_totals(s, F.col("bp"), F.col("bases") - F.col("bp")), _totals(own, on, off), sim_speed)
