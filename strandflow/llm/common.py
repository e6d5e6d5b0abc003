"""Shared pieces: columns by position, the shared scratch folder, bounded Arrow batches and small model fitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *names: str, carry: bool = False) -> DataFrame:
    """Only the named columns and, with ``carry``, the whole input row as the struct ``row`` (fields c0, c1, ...).

    Columns are found by exact name, else by their lower-cased one, and taken by position, so that no other column of
    the input can clash, whatever it is called (dots, quotes, other case, a name used inside an operator).
    """
    places = {c.lower(): i for i, c in reversed(list(enumerate(df.columns)))} | {c: i for i, c in reversed(list(enumerate(df.columns)))}
    cols = [f"c{i}" for i in range(len(df.columns))]
    out = [F.col(f"c{places[n]}").alias(n) for n in names] + [F.struct(*cols).alias("row")] * carry
    return df.toDF(*cols).select(*out)


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from the struct ``row`` that ``plain`` made."""
    return df.select(*[F.col(f"row.c{i}") for i in range(len(like.columns))]).toDF(*like.columns)


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as memory follows the longest texts. The session keeps these settings: plans are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandflow-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


#: The folder that scratch goes to, while ``scratch_folder`` holds.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_FOLDER.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[None]:
    """Scratch of what runs inside goes to a folder of its own, which is deleted at the end: results must have been written by then."""
    path = scratch_path(spark, label)
    token = _FOLDER.set(path)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        remove(spark, path)


def stored(df: DataFrame, label: str, under: str | None = None) -> DataFrame:
    """Write a table to the shared folder (or ``under`` a folder in it) and read it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{under}/{label}-{uuid.uuid4().hex}" if under else scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for L2 logistic loss with soft labels y in [0, 1]; x holds its own constant column, if any."""
    n, d = x.shape
    w = np.zeros(d)
    g = np.ones(n) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (g * (p - y)) / n + l2 * w
        hess = (x * (g * p * (1 - p))[:, None]).T @ x / n + l2 * np.eye(d)
        step = np.linalg.solve(hess, grad)
        # a bounded step keeps separable data from running away
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
