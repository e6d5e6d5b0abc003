"""Curves of few knots: power curves, interpolation, survival and histogram shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def power_curve(t: Column, low: float, high: float, exponent: float) -> Column:
    """low + t ** exponent * (high - low), for t in [0, 1]."""
    return low + F.pow(t, F.lit(exponent)) * (high - low)


def interpolate(points: DataFrame, x: str, knots: DataFrame, out: str = "y") -> DataFrame:
    """Linear interpolation of column ``x`` between knots (x, y), held at the ends. A curve's knots are few: they travel as one array."""
    curve = knots.agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_k"))
    j = points.crossJoin(F.broadcast(curve)).withColumns({"_a": F.element_at(F.filter("_k", lambda s: s["x"] <= F.col(x)), -1), "_b": F.get(F.filter("_k", lambda s: s["x"] >= F.col(x)), 0)})
    lerp = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * (F.col(x) - F.col("_a.x")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    value = F.when(F.col("_b").isNull(), F.col("_a.y")).when(F.col("_a").isNull(), F.col("_b.y")).otherwise(F.coalesce(lerp, F.col("_a.y")))
    return j.withColumn(out, value).drop("_k", "_a", "_b")


def survival(lengths: DataFrame, length: str, upto: int, rare: int = 20) -> DataFrame:
    """(len, n, rare) for 1 to ``upto``: how many lengths reach each value, and whether at most one in ``rare`` does."""
    n = lengths.groupBy(F.col(length).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))  # one row
    over = n.agg(F.coalesce(F.sum(F.when(F.col("len") > upto, F.col("c"))), F.lit(0)).alias("over"))  # one row
    full = lengths.sparkSession.range(1, upto + 1).select(F.col("id").alias("len")).join(n, "len", "left").na.fill(0, ["c"])
    reach = F.sum("c").over(Window.orderBy(F.col("len").desc())) + F.col("over")  # ``upto`` rows
    return full.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(over)).select("len", reach.alias("n"), (reach * rare <= F.col("total")).alias("rare"))


def shares(df: DataFrame, by: str, value: Column, name: str = "bin") -> DataFrame:
    """(by, name, n, share): a histogram of ``value`` in each group, and each bin's share of its group."""
    h = df.groupBy(by, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
