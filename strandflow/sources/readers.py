"""Readers and writers of the text formats, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandflow.operators import pafstats

SUMMARY_FIELDS = ["channel", "start_time", "duration", "mux", "read_id", "template_start", "template_duration", "sequence_length_template"]


def read_paf(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Alignment records; the first ``most`` in the order of the files and their lines, if given."""
    lines = spark.read.text(path)
    if most is not None:
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        lines = lines.filter(~F.col("value").startswith("#")).select("value", *[c.alias(f"_{i}") for i, c in enumerate(place)]).orderBy("_0", "_1", "_2").limit(most).select("value")
    return pafstats.parse(lines)


def write_paf(df: DataFrame, path: str, stars: int = 9) -> None:
    """Records as lines, with their ``tags`` (a map of name to type and value) if they have that column."""
    line = pafstats.format_line(stars)
    df.select((F.concat(line, pafstats.format_tags(F.col("tags"))) if "tags" in df.columns else line).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each record, wrapped lines joined; letters before the first ``>`` are ignored."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.btrim("value") != "")
    parts = rows.select(F.split("value", r"\r?\n", 2).alias("p"))
    return parts.select(F.get(F.split(F.get("p", 0), r"\s+"), 0).alias("name"), F.regexp_replace(F.coalesce(F.get("p", 1), F.lit("")), r"\s+", "").alias("seq"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("p")).filter(F.size("p") >= 3)
    return parts.select(F.get("p", 0).alias("chrom"), F.get("p", 1).cast("long").alias("st"), F.get("p", 2).cast("long").alias("en"), F.get("p", 3).alias("name"))


def read_summary(spark: SparkSession, path: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """A run summary with a header; reads that start before ``lo`` or end after ``hi`` (seconds) are dropped."""
    df = spark.read.csv(path, sep="\t", header=True).select(*SUMMARY_FIELDS)
    whole = ("channel", "mux", "sequence_length_template")
    df = df.select(*[F.col(c).cast("long" if c in whole else "string" if c == "read_id" else "double").alias(c) for c in SUMMARY_FIELDS])
    if lo is not None:
        df = df.filter(F.col("start_time") >= lo)
    if hi is not None:
        df = df.filter(F.col("start_time") + F.col("duration") <= hi)
    return df


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema="name string, list string, prob double, speed double")
    return df.withColumn("thresholds", F.transform(F.split("list", ","), lambda x: x.cast("double"))).drop("list")


def write_presets(df: DataFrame, path: str) -> None:
    df.select("name", F.array_join(F.transform("thresholds", lambda x: x.cast("string")), ",").alias("list"), "prob", "speed").write.csv(path, sep="\t")


def pick_preset(presets: DataFrame, name: str = "") -> list[float]:
    """The thresholds of a preset; of no name, those of the file's last line."""
    rows = presets.withColumn("_i", F.monotonically_increasing_id())
    found = (rows.filter(F.col("name") == name) if name else rows).orderBy(F.col("_i").desc()).first()
    if found is None:
        raise ValueError(f"no preset {name!r}")
    return list(found.thresholds)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Sequence names and places of an index annotation: a header, then two lines a sequence (name line; offset, length, holes)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("i", "line")).filter("i > 0")
    first = lines.filter("i % 2 = 1").select(((F.col("i") + 1) / 2).cast("int").alias("n"), F.get(F.split("line", " "), 1).alias("name"))
    second = lines.filter("i % 2 = 0").select((F.col("i") / 2).cast("int").alias("n"), F.get(F.split("line", " "), 0).cast("long").alias("offset"), F.get(F.split("line", " "), 1).cast("long").alias("len"))
    return first.join(second, "n").select((F.col("n") - 1).alias("rid"), "name", "offset", "len")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, p): fields of every line, numbered within its file. A dump is one read's, so files are short."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("i", "line"))
    return lines.select("file", F.col("i").cast("long").alias("i"), F.split(F.btrim("line"), r"\s+").alias("p")).filter("p[0] <> ''")


def read_event_dump(spark: SparkSession, path: str) -> DataFrame:
    """A read's events, numbered after the header line."""
    names = ["mean", "stdv", "norm_scale", "norm_shift", "win_mean", "win_stdv"]
    rows = _numbered(spark, path).filter("i > 0")
    numbers = [F.get("p", i + 2).cast("double").alias(c) for i, c in enumerate(names)]
    return rows.select("file", (F.col("i") - 1).alias("evt"), F.get("p", 0).cast("long").alias("start"), F.get("p", 1).cast("long").alias("length"), *numbers, (F.get("p", 8) == "1").alias("mask"))


def parse_seeds(lines: DataFrame, column: str = "value") -> DataFrame:
    """Seed lines (sequence, start, end, event:path:cluster, strand), which hold all that their order means."""
    p, name = F.split(F.btrim(F.col(column)), r"\s+"), F.split("_name", ":")
    rows = lines.select(p.alias("p")).filter(F.size("p") >= 5).withColumn("_name", F.get("p", 3))
    cols = [F.get(name, i).cast("long").alias(c) for i, c in enumerate(("evt", "path", "cluster"))]
    return rows.select(F.get("p", 0).alias("rf"), F.get("p", 1).cast("long").alias("st"), F.get("p", 2).cast("long").alias("en"), *cols, (F.get("p", 4) == "+").alias("is_fwd"))


def read_path_dump(spark: SparkSession, path: str) -> DataFrame:
    """A read's paths; fields stand by the header's names, and a header that comes again is no row."""
    rows = _numbered(spark, path)
    head = rows.filter("i = 0").select("file", F.col("p").alias("h"))
    rows = rows.join(head, "file").filter("p[0] <> h[0]").select("file", F.map_from_arrays("h", F.slice("p", F.lit(1), F.size("h"))).alias("m"))
    kinds = {"parent": "string", "fm_start": "long", "fm_len": "long", "kmer": "string", "full_len": "int", "match_prob": "double", "moves": "string"}
    ident = F.split(F.col("m")["id"], ":")
    return rows.select("file", F.get(ident, 0).cast("long").alias("evt"), F.get(ident, 1).cast("long").alias("path"), *[F.col("m")[c].cast(t).alias(c) for c, t in kinds.items()])


def read_confidence_dump(spark: SparkSession, path: str) -> DataFrame:
    rows = _numbered(spark, path).filter("i > 0")
    return rows.select("file", F.get("p", 0).cast("long").alias("evt"), F.get("p", 1).cast("long").alias("cluster"), F.get("p", 2).cast("double").alias("top"), F.get("p", 3).cast("double").alias("mean"))


def read_dtw_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="rd_name string, rd_st long, rd_en long, rf_name string, rf_st long, rf_en long, strand string")


def read_schedule(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The simulator's tables: intervals, gaps, delays and reads, each with its order in the file."""
    kinds = {"itvs": "ch long, i long, st long, en long", "gaps": "ch long, i long, len long", "delays": "ch long, i long, len long", "reads": "ch long, read_id string, offset long"}
    return {k: spark.read.csv(f"{folder}/*_{k}.txt", sep="\t", schema=s) for k, s in kinds.items()}


def instrument_ports(lines: DataFrame, column: str = "value") -> DataFrame:
    """(position, port) pairs of a log's lines."""
    m = lambda g: F.regexp_extract(column, r"position[ =:]+(\S+).*?port[ =:]+([0-9]+)", g)
    return lines.select(m(1).alias("position"), m(2).try_cast("int").alias("port")).filter("port is not null")


def only_reads(reads: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """Reads of a list of ids (its first ``most`` in order, if given)."""
    wanted = ids.select("read_id").distinct()
    if most is not None:
        wanted = wanted.orderBy("read_id").limit(most)
    return reads.join(wanted, "read_id", "left_semi")


def decode_samples(raw: Column, dtype: str) -> Column:
    """Little-endian samples (float32, int16 or int32) as floats; any other type gives an empty array."""

    @pandas_udf("array<float>")
    def decode(s):
        import numpy as np

        known = {"float32": "<f4", "int16": "<i2", "int32": "<i4"}
        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype=known[dtype]).astype("float32").tolist() if dtype in known else [])

    return decode(raw)
