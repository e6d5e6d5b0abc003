"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Quality rules, quality classifier, near duplicates and benchmark decontamination each drop documents and return
the columns of ``documents`` (decontamination also cuts hit spans out of the texts that stay); packing returns the pieces
of what is left. ``run`` writes every stage's rows as Parquet in the shared folder and rereads them as the next one's
documents; a stage's own scratch and the rows of the stage before are deleted once its rows are written.

Edge cases: a null, empty or word-less text fails the quality rules. Rows are judged one by one, so rows with a null or
shared doc_id are kept or dropped by their texts; of repeated rows one stays after the near duplicates. Ties are those of
the operators: documents of equal quality score stay or go together. Very long texts pass through whole. An empty table
gives empty stages. Other columns pass through untouched, whatever their names, until packing, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import decontam, near_dup, packing, quality_ranker, quality_rules
from strandflow.llm.common import remove, scratch_folder, scratch_path, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_ranker.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the learned classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_folder(spark, "scratch"):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
