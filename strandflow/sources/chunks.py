"""Chunks of live reads: from whole reads, and as a stream from a folder that receives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import signal as S

SCHEMA = "channel long, number long, chunk_idx long, start_sample long, samples array<double>"


def from_reads(reads: DataFrame, size: int = 4000, tail: bool = True) -> DataFrame:
    """reads (channel, number, start_sample, signal) to their chunks; ``tail`` keeps a short last one. Empty signals have none."""
    at = F.posexplode(S.chunks(F.size("signal"), size, tail)).alias("_i", "_at")
    cut = reads.filter(F.size("signal") > 0).select("channel", "number", "start_sample", "signal", at)
    samples = F.slice("signal", (F.col("_at") + 1).cast("int"), size).cast("array<double>")
    return cut.select(F.col("channel").cast("long").alias("channel"), F.col("number").cast("long").alias("number"), F.col("_i").cast("long").alias("chunk_idx"), (F.col("start_sample") + F.col("_at")).cast("long").alias("start_sample"), samples.alias("samples"))


def write_rounds(chunks: DataFrame, path: str, round_samples: int) -> None:
    """Replay: one folder of Parquet for each stretch of ``round_samples`` by start, as a device would hand them over."""
    chunks.withColumn("round", F.floor(F.col("start_sample") / round_samples)).repartition("round").write.partitionBy("round").parquet(path)


def stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """The chunks of a folder as they come, at most ``files`` a trigger."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def emitted(chunks: DataFrame, tick: int) -> DataFrame:
    """Chunks with the tick (a stretch of ``tick`` samples of run time) in which a device hands them over: the one that their last sample falls before the end of."""
    return chunks.withColumn("tick", F.ceil((F.col("start_sample") + F.size("samples")) / tick))


def device_chunks(timeline: DataFrame, reads: DataFrame, size: int = 4000) -> DataFrame:
    """A simulated run's chunks: the reads of a timeline (channel, n, st, en in seconds) cut as a device would hand them over.

    ``reads``: channel, k (0, 1, ... in a channel), signal; a channel goes through its reads in turn. A read that the
    timeline ends early (by an ejection or its interval's end) is cut there.
    """
    last = reads.groupBy(F.col("channel").alias("_c")).agg((F.max("k") + 1).alias("_of"))
    turns = timeline.join(last, F.col("channel") == F.col("_c")).select("channel", F.col("n").alias("number"), F.pmod(F.col("n"), F.col("_of")).alias("_k"), F.bround(F.col("st") * S.SAMPLES_PER_SECOND).cast("long").alias("start_sample"), F.bround((F.col("en") - F.col("st")) * S.SAMPLES_PER_SECOND).cast("int").alias("_len"))
    own = reads.select(F.col("channel").alias("_rc"), "k", "signal")
    whole = turns.join(own, (F.col("channel") == F.col("_rc")) & (F.col("_k") == F.col("k")))
    return from_reads(whole.select("channel", "number", "start_sample", F.slice("signal", F.lit(1), F.greatest(F.col("_len"), F.lit(0))).alias("signal")), size)
