"""The logical tables that the queries run on, made from the relational fixtures; and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions import kmers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal_long(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.col("value") - F.floor(F.col("value") / 60) * 60 + 60
    return table(spark, sf, "events").select(F.col("user_id").alias("read_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), x.alias("x"))


SIGNAL = "sig AS (SELECT user_id AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value - floor(value / 60) * 60 + 60 AS x FROM events)"


def reads(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("read_id"), F.col("label").alias("channel"), F.transform("embedding", lambda e: 90 + 100 * e.cast("double")).alias("signal"))


def sequences(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", kmers.clean(F.col("text")).alias("seq"))


SEQUENCES = "seqs AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", kmers.clean(F.col("text")).alias("seq"))


ITEMS = "items AS (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


def paf(spark, sf) -> DataFrame:
    """Alignment records with their place ``rn`` in their order; 1 is the query's own, the rest are truth rows."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("qr_name"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("rf_name"), F.lit(5000).cast("long").alias("rf_len"),
        F.col("l_partkey").alias("rf_st"), (F.col("l_partkey") + 200).alias("rf_en"), F.lit(1000).cast("long").alias("qr_len"),
        F.col("l_quantity").cast("long").alias("qr_st"), (F.col("l_quantity").cast("long") + 200).alias("qr_en"),
        (F.col("l_returnflag") != "N").alias("is_mapped"), (F.col("l_linestatus") == "O").alias("is_fwd"), F.col("l_extendedprice").alias("mt"), F.row_number().over(w).alias("rn"),
    )


PAF = """paf AS (SELECT l_orderkey AS qr_name, 's' || (l_suppkey % 5) AS rf_name, CAST(5000 AS BIGINT) AS rf_len, l_partkey AS rf_st, l_partkey + 200 AS rf_en, CAST(1000 AS BIGINT) AS qr_len,
  CAST(l_quantity AS BIGINT) AS qr_st, CAST(l_quantity AS BIGINT) + 200 AS qr_en, l_returnflag <> 'N' AS is_mapped, l_linestatus = 'O' AS is_fwd, l_extendedprice AS mt,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)"""


def bed(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_partkey").alias("st"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("en"), F.col("l_orderkey").alias("name"))


BED = "bed AS (SELECT l_suppkey AS chrom, l_partkey AS st, l_partkey + CAST(l_quantity AS BIGINT) AS en, l_orderkey AS name FROM lineitem)"


def summary(spark, sf) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("channel"), us.alias("st"), (us + F.round(F.col("value") * 1000000).cast("long")).alias("en"), (F.col("event_id") % 4 + 1).alias("mux"))


SUMMARY = "summ AS (SELECT event_id AS read_id, user_id AS channel, epoch_us(ts) AS st, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS en, event_id % 4 + 1 AS mux FROM events)"

#: The rule model of strandflow.functions.model, as a CTE.
MODEL = "model AS (SELECT k AS kmer, 60 + (k * 389 % 1024) * (60.0 / 1024) AS level_mean, 1.5 + CAST(k % 7 AS DOUBLE) / 10 AS level_stdv FROM range(1024) AS r(k))"
