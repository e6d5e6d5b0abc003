"""Alignment records: text form, accuracy against truth, speed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["qr_name", "qr_len", "qr_st", "qr_en", "strand", "rf_name", "rf_len", "rf_st", "rf_en", "match_num", "aln_len", "qual"]


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to records: ``#`` lines are skipped, ``*`` is null, tags (name:type:value) become a map. A value may hold colons."""
    parts = lines.select(F.split(F.btrim(F.col(column)), r"\s+").alias("p")).filter(~F.get("p", 0).startswith("#") & (F.get("p", 0) != ""))
    field = lambda i: F.nullif(F.get("p", i), F.lit("*"))
    tags = F.transform(F.slice("p", 13, F.greatest(F.size("p") - 12, F.lit(0))), lambda t: F.split(t, ":", 3))
    pair = lambda t: F.struct(F.get(t, 0), F.struct(F.get(t, 1).alias("type"), F.get(t, 2).alias("value")))
    cols = [field(i).alias(n) if n in ("qr_name", "strand", "rf_name") else field(i).cast("long").alias(n) for i, n in enumerate(FIELDS)]
    return parts.select(*cols, F.map_from_entries(F.transform(tags, pair)).alias("tags")).withColumns({"is_mapped": F.col("rf_name").isNotNull(), "is_fwd": F.col("strand") == "+"})


def tag(name: str) -> Column:
    return F.element_at("tags", name)["value"]


def typed(value: Column, kind: Column) -> Column:
    """A tag's value as a struct (i, f, z) with the one that its type names, the others null."""
    of = lambda t, cast: F.when(kind == t, value.try_cast(cast))
    return F.struct(of("i", "long").alias("i"), of("f", "double").alias("f"), F.when(~kind.isin("i", "f"), value).alias("z"))


def set_tag(tags: Column, name: str, value: Column, kind: str) -> Column:
    """Tags with one set, in place of an older one of its name; ``kind`` is i, f or Z."""
    rest = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,struct<type:string,value:string>>")), lambda k, _: k != name)
    own = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, own))


def tags_by_read(calls: DataFrame, name: str, order: str) -> DataFrame:
    """(qr_name, values): a tag's values of all records of a read, in order."""
    found = calls.select("qr_name", F.struct(F.col(order).alias("o"), tag(name).alias("v")).alias("x")).filter("x.v is not null")
    return found.groupBy("qr_name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values"))


def format_tags(tags: Column) -> Column:
    """Tags as they stand behind a line, by name, each with a tab before it; nothing for none."""
    rows = F.array_sort(F.map_entries(tags))
    return F.coalesce(F.concat(*[F.array_join(F.transform(rows, lambda e: F.concat(F.lit("\t"), e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"])), "")]), F.lit(""))


def format_line(stars: int = 9) -> Column:
    """A record as a tab-separated line; an unmapped one has ``stars`` stars (9 and the quality, or 10 without it)."""
    s = lambda c: F.col(c).cast("string")
    mapped = F.concat_ws("\t", s("qr_name"), s("qr_len"), s("qr_st"), s("qr_en"), F.when(F.col("is_fwd"), "+").otherwise("-"), s("rf_name"), s("rf_len"), s("rf_st"), s("rf_en"), s("match_num"), (F.col("rf_en") - F.col("rf_st") + 1).cast("string"), F.lit("255"))
    blank = F.concat_ws("\t", s("qr_name"), s("qr_len"), *[F.lit("*")] * stars, *([F.lit("255")] if stars == 9 else []))
    return F.when(F.col("is_mapped"), mapped).otherwise(blank)


def swap_roles(df: DataFrame) -> DataFrame:
    """Query and reference change places."""
    pairs = {"qr_name": "rf_name", "qr_len": "rf_len", "qr_st": "rf_st", "qr_en": "rf_en"}
    both = pairs | {v: k for k, v in pairs.items()}
    return df.select(*[F.col(both.get(c, c)).alias(c) for c in df.columns])


def extended_span(ext: float = 1.5) -> tuple[Column, Column]:
    """The aligned span stretched by ``ext`` times what the read has left on either side, held in [1, rf_len]."""
    left = (F.lit(ext) * F.col("qr_st")).cast("long")
    right = (F.lit(ext) * (F.col("qr_len") - F.col("qr_en"))).cast("long")
    st = F.col("rf_st") - F.when(F.col("is_fwd"), left).otherwise(right)
    en = F.col("rf_en") + F.when(F.col("is_fwd"), right).otherwise(left)
    return F.greatest(st, F.lit(1)), F.least(en, F.col("rf_len"))


def classify(calls: DataFrame, truth: DataFrame, ext: float = 1.5) -> DataFrame:
    """Each call with its class: tp, fp, tn, fn or na. ``truth`` has file order ``rn`` per qr_name.

    A mapped call is na if its first truth row is missing or unmapped, else tp if any mapped truth row's name is a
    prefix of its own and the extended spans meet. An unmapped call is tn if the first truth row is missing or
    unmapped, else fn.
    """
    st, en = extended_span(ext)
    call = calls.withColumns({"c_st": st, "c_en": en})
    t = truth.withColumns({"t_st": st, "t_en": en}).select(F.col("qr_name").alias("t_qr"), F.col("rf_name").alias("t_rf"), F.col("is_mapped").alias("t_mapped"), "t_st", "t_en", F.col("rn").alias("t_rn"))
    joined = call.select("qr_name", "rf_name", "is_mapped", "c_st", "c_en").join(t, F.col("qr_name") == F.col("t_qr"), "left")
    hit = F.col("is_mapped") & F.col("t_mapped") & F.col("rf_name").startswith(F.col("t_rf")) & (F.col("c_st") <= F.col("t_en")) & (F.col("t_st") <= F.col("c_en"))
    seen = joined.groupBy("qr_name", "is_mapped").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"), F.coalesce(F.min_by("t_mapped", "t_rn"), F.lit(False)).alias("first"))
    cls = F.when(F.col("is_mapped"), F.when(~F.col("first"), "na").when(F.col("hit"), "tp").otherwise("fp")).otherwise(F.when(F.col("first"), "fn").otherwise("tn"))
    return seen.select("qr_name", cls.alias("cls"))


def confusion(classified: DataFrame) -> DataFrame:
    n = classified.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    total = classified.agg(F.count(F.lit(1)).alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("cls", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("pct"))


def speed(df: DataFrame) -> DataFrame:
    """Mean and exact median of bases per second, bases and milliseconds over mapped reads."""
    m = df.filter("is_mapped").select((1000 * F.col("qr_en") / F.col("mt")).alias("bps"), F.col("qr_en").cast("double").alias("bp"), F.col("mt").alias("ms"))
    return m.agg(*[f(c).alias(f"{n}_{c}") for c in ("bps", "bp", "ms") for n, f in (("mean", F.avg), ("median", F.median))])


def locate(clusters: DataFrame, size: str, k: int = 5) -> DataFrame:
    """Best cluster (ref_st, ref_en on both strands' coordinates) to a forward reference place and strand."""
    fwd = F.col("ref_st") < F.col(size) / 2
    start = F.when(fwd, F.col("ref_st")).otherwise(F.col(size) - (F.col("ref_en") + k - 1))
    return clusters.withColumns({"is_fwd": fwd, "rf_st": start, "rf_en": start + F.col("ref_en") - F.col("ref_st") + k, "matches": F.col("total_len") + k - 1})
