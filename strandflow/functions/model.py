"""The k-mer current model: a table (kmer, kmer_str, level_mean, level_stdv)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import kmers


def read_model(spark: SparkSession, path: str, complement: bool = False) -> DataFrame:
    """A tab-separated model file with a header: kmer, level mean, level stdv."""
    df = spark.read.csv(path, sep="\t", header=True, schema="kmer_str string, level_mean double, level_stdv double")
    if complement:
        df = df.withColumn("kmer_str", kmers.complement(F.col("kmer_str")))
    return df.select(kmers.encode(F.col("kmer_str")).alias("kmer"), "kmer_str", "level_mean", "level_stdv")


def rule_model(spark: SparkSession, k: int = 5) -> DataFrame:
    """A model by rule, for tests and fixtures: levels spread evenly over 60 to 120 in a scrambled order."""
    n = 4**k
    df = spark.range(n).select(F.col("id").alias("kmer"))
    mean = 60 + (F.col("kmer") * 389 % n) * (60.0 / n)
    return df.select("kmer", kmers.decode(F.col("kmer"), k).alias("kmer_str"), mean.alias("level_mean"), (1.5 + F.col("kmer") % 7 / 10).alias("level_stdv"))


def model_stats(model: DataFrame) -> DataFrame:
    return model.agg(F.avg("level_mean").alias("mean"), F.stddev_pop("level_mean").alias("stdv"))
