"""Simulated references, reads and their mapping; and the simulator's channel timeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.operators.mapper import K, MapConfig, Mapper


def make_reference(length: int, seed: int = 5) -> str:
    return "".join(np.random.default_rng(seed).choice(list("ACGT"), length))


def make_model(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Levels of all 5-mers, spread as a sensor's would be."""
    rng = np.random.default_rng(seed)
    return 90 + 12.8 * rng.standard_normal(4**K), np.full(4**K, 1.5)


def read_signal(seq: str, mean: np.ndarray, stdv: np.ndarray, rng) -> np.ndarray:
    """About nine samples a k-mer (4000 samples a second, 450 bases a second)."""
    codes = np.array(["ACGT".index(b) for b in seq])
    kmers = sum(codes[i : len(codes) - K + 1 + i] * 4 ** (K - 1 - i) for i in range(K))
    lengths = rng.integers(7, 12, len(kmers))
    which = np.repeat(kmers, lengths)
    return rng.normal(mean[which], stdv[which] * 0.7)


def make_reads(n: int, ref: str, mean: np.ndarray, stdv: np.ndarray, bases: int = 400, seed: int = 9) -> pd.DataFrame:
    """(read_id, true_st, true_fwd, signal)."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        st, fwd = int(rng.integers(0, len(ref) - bases)), bool(rng.integers(0, 2))
        seq = ref[st : st + bases]
        if not fwd:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        rows.append((i, st, fwd, read_signal(seq, mean, stdv, rng).tolist()))
    return pd.DataFrame(rows, columns=["read_id", "true_st", "true_fwd", "signal"])


#: The made reference and configuration of the queries.
MADE_LENGTH, MADE_CONF = 10_000, MapConfig(thresholds=(-8.0, -5.0, -4.0, -3.6, -3.4, -3.4))


def made_mapper() -> Mapper:
    return Mapper(make_reference(MADE_LENGTH), *make_model(), MADE_CONF)


def reads_by_key(keys: DataFrame, bases: int) -> DataFrame:
    """keys (read_id) to (read_id, true_st, true_fwd, signal): a read of the made reference for each, made in tasks from its key alone.

    Keys are dealt out to four tasks a core: what is done with a read takes far longer than its key's bytes in a file show.
    """

    def run(batches):
        ref, (mean, stdv) = make_reference(MADE_LENGTH), make_model()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            rows = []
            for key in batch.column("read_id").to_pylist():
                rng = np.random.default_rng(key)
                st, fwd = int(rng.integers(0, len(ref) - bases)), bool(rng.integers(0, 2))
                seq = ref[st : st + bases]
                seq = seq if fwd else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
                rows.append((key, st, fwd, read_signal(seq, mean, stdv, rng)))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["read_id", "true_st", "true_fwd", "signal"])

    tasks = 4 * keys.sparkSession.sparkContext.defaultParallelism
    return keys.selectExpr("cast(read_id as bigint) read_id").filter("read_id is not null").repartition(tasks).mapInArrow(run, "read_id long, true_st long, true_fwd boolean, signal array<double>")


def timeline(channels: DataFrame, eject: DataFrame | None = None, eject_time: float = 0.1) -> DataFrame:
    """Reads of each channel in time: (channel, n, st, en). A channel cycles its reads and gaps within its active intervals.

    ``channels``: channel, intervals (array of st, en), gaps and lengths (arrays of seconds). ``eject``: channel, n and the
    delay after which a read is ejected, which shortens it and lengthens the next gap by ``eject_time``.
    """
    from pyspark.sql import functions as F

    if eject is not None:
        e = eject.groupBy("channel").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), F.col("delay").cast("double")))).alias("ejected"))
        channels = channels.join(e, "channel", "left")
    else:
        channels = channels.withColumn("ejected", F.lit(None).cast("map<string,double>"))

    def run(frames):
        for f in frames:
            rows = []
            for c in f.itertuples():
                out, n, extra = [], 0, 0.0
                cut = dict(c.ejected) if c.ejected is not None else {}
                for st, en in ((x["st"], x["en"]) for x in c.intervals):
                    t = st
                    while len(c.lengths) and len(c.gaps):
                        t += c.gaps[n % len(c.gaps)] + extra
                        if t >= en:
                            break
                        end = min(t + c.lengths[n % len(c.lengths)], en)
                        extra = 0.0
                        if str(n) in cut and t + cut[str(n)] < end:
                            end, extra = t + cut[str(n)], eject_time
                        out.append((c.channel, n, t, end))
                        if end <= t and c.gaps[n % len(c.gaps)] + extra <= 0:
                            raise ValueError("a channel's time stands still")
                        t, n = end, n + 1
                rows += out
            yield pd.DataFrame(rows, columns=["channel", "n", "st", "en"])

    return channels.select("channel", "intervals", "gaps", "lengths", "ejected").mapInPandas(run, "channel long, n long, st double, en double")
