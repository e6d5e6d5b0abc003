"""Closed integer intervals [start, end], an invalid one being null or start > end; and interval-set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(st: Column, en: Column) -> Column:
    return F.coalesce(st <= en, F.lit(False))


def length(st: Column, en: Column) -> Column:
    return F.when(valid(st, en), en - st + 1).otherwise(F.lit(0).cast("long"))


def intersects(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return valid(*a) & valid(*b) & (a[0] <= b[1]) & (b[0] <= a[1])


def intersection(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Null where the two do not meet."""
    meet = intersects(a, b)
    return F.when(meet, F.greatest(a[0], b[0])), F.when(meet, F.least(a[1], b[1]))


def hull(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The merged interval, null where the two do not meet."""
    meet = intersects(a, b)
    return F.when(meet, F.least(a[0], b[0])), F.when(meet, F.greatest(a[1], b[1]))


def reciprocal_overlap(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    i, h = intersection(a, b), hull(a, b)
    return F.when(intersects(a, b), (i[1] - i[0] + 1) / (h[1] - h[0] + 1)).otherwise(F.lit(0.0))


def split(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """What is left of a on either side of b, as an array of structs (st, en)."""
    meet = intersects(a, b)
    part = lambda ok, st, en: F.when(ok, F.struct(st.alias("st"), en.alias("en")))
    pieces = F.array(part(meet & (a[0] < b[0]), a[0], b[0] - 1), part(meet & (a[1] > b[1]), b[1] + 1, a[1]), part(~meet & valid(*a), a[0], a[1]))
    return F.array_compact(pieces)


def _islands(df: DataFrame, by: list[str], st: str, en: str, gap: int | float) -> DataFrame:
    """Rows with a count ``n`` to islands with the sum of theirs."""
    order = Window.partitionBy(*by).orderBy(st, en)
    reach = F.max(en).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(st) - reach <= gap, 0).otherwise(1))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min(st).alias(st), F.max(en).alias(en), F.sum("n").alias("n")).drop("_island")


def merge(df: DataFrame, by: list[str], st: str, en: str, gap: int | float = 0, width: int | float | None = None) -> DataFrame:
    """Islands: rows of a group join while the next start is at most ``gap`` past the running end. Half-open or closed alike.

    With ``width``, rows are merged within stretches of that width first, so that a group of very many rows is shared out
    and its last, ordered pass sees islands only.
    """
    rows = df.select(*by, st, en).withColumn("n", F.lit(1).cast("long"))
    if width is not None:
        rows = _islands(rows.withColumn("_w", F.floor(F.col(st) / width)), [*by, "_w"], st, en, gap).drop("_w")
    return _islands(rows, by, st, en, gap)


def gaps(df: DataFrame, by: list[str], st: str, en: str, lo: str, hi: str) -> DataFrame:
    """The parts of [lo, hi] of each group that its closed intervals leave uncovered (the interval complement)."""
    merged = merge(df, [*by, lo, hi], st, en, gap=1)
    order = Window.partitionBy(*by).orderBy(st)
    before = merged.select(*by, F.coalesce(F.lag(en).over(order) + 1, F.col(lo)).alias("gap_st"), (F.col(st) - 1).alias("gap_en"))
    after = merged.groupBy(*by, hi).agg(F.max(en).alias("_last")).select(*by, (F.col("_last") + 1).alias("gap_st"), F.col(hi).alias("gap_en"))
    return before.unionByName(after).filter("gap_st <= gap_en")


def range_join(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Points in half-open ranges [lo, hi) by an equi-join on bins of ``width``: a range is listed once in each bin it meets, a point in one."""
    on = on or []
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    r = ranges.filter(F.col(lo) < F.col(hi)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return p.join(r, [*on, "_bin"]).filter((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_bin")


def overlap_join(a: DataFrame, b: DataFrame, a_iv: tuple[str, str], b_iv: tuple[str, str], width: int, on: list[str]) -> DataFrame:
    """Pairs of closed intervals that meet, found in the first bin that both have."""
    bins = lambda iv: F.sequence(F.floor(F.col(iv[0]) / width), F.floor(F.col(iv[1]) / width))
    x = a.withColumn("_bin", F.explode(bins(a_iv)))
    y = b.withColumn("_bin", F.explode(bins(b_iv)))
    first = F.floor(F.greatest(F.col(a_iv[0]), F.col(b_iv[0])) / width)
    return x.join(y, [*on, "_bin"]).filter((F.col(a_iv[0]) <= F.col(b_iv[1])) & (F.col(b_iv[0]) <= F.col(a_iv[1])) & (F.col("_bin") == first)).drop("_bin")
