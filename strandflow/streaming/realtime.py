"""The live loop: decisions per read, and a stateful stream of chunks by channel.

State follows the channel, not the read: the rolling scale goes on over reads, while samples, events and the search belong
to the read under way. Each chunk is cut into events, scaled and mapped as it comes. Results do not depend on how chunks
fall into micro-batches: there are no wall-clock budgets, only counts of chunks, events and samples.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupStateTimeout

from strandflow.functions.signal import BASES_PER_SECOND, SAMPLES_PER_SECOND
from strandflow.operators.mapper import Beam, Mapper, worker_mapper
from strandflow.operators.segment import events
from strandflow.streaming.normaliser import RollingScale


def decide(ended: Column, mapped: Column, in_scan: Column, mode: str = "enrich") -> Column:
    """en: the read has ended; ej: eject it; mx: it would be ejected, but not during a scan; kp: keep."""
    if mode not in ("enrich", "deplete"):
        raise ValueError(mode)
    eject = mapped if mode == "deplete" else ~mapped
    return F.when(ended, "en").when(eject & in_scan, "mx").when(eject, "ej").otherwise("kp")


def channel_parity(channel: Column, keep: str) -> Column:
    return channel % 2 == (0 if keep == "even" else 1)


def late_chunks(chunks: DataFrame, ejected: DataFrame) -> DataFrame:
    """Chunks of a channel's read that came after the read was ejected."""
    e = ejected.select(F.col("channel").alias("_c"), F.col("number").alias("_n"), F.col("at").alias("_at"))
    return chunks.join(e, (F.col("channel") == F.col("_c")) & (F.col("number") == F.col("_n")) & (F.col("start_sample") > F.col("_at")), "left_semi")


def scan_detect(events: DataFrame, share: float = 0.99) -> DataFrame:
    """Last mux of each channel, then the commonest one and whether nearly all channels that have one are on it."""
    last = events.groupBy("channel").agg(F.max_by("mux", F.struct("st", "read_id")).alias("mux"))
    n = last.groupBy("mux").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max(F.struct("n", "mux")).alias("top"), F.sum(F.when(F.col("mux") != 0, F.col("n")).otherwise(0)).alias("used")).select(
        F.col("top.mux").alias("mux"), F.round(F.col("top.n") / F.col("used"), 4).alias("share"), ((F.col("top.mux") != 0) & (F.col("top.n") / F.col("used") > share)).alias("scanning")
    )


#: Samples without a chunk after which a read is given up (four seconds), and events after which it is.
PATIENCE = 16_000

_FIELDS = [("channel", T.LongType()), ("number", T.LongType()), ("outcome", T.StringType()), ("n_chunks", T.LongType()), ("n_samples", T.LongType()), ("n_events", T.LongType()), ("at_sample", T.LongType()), ("is_fwd", T.BooleanType()), ("rf_name", T.StringType()), ("rf_len", T.LongType()), ("rf_st", T.LongType()), ("rf_en", T.LongType()), ("matches", T.LongType()), ("qr_len", T.LongType())]
OUT = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
NAMES = [n for n, _ in _FIELDS]
STATE = T.StructType([T.StructField("state", T.BinaryType())])


class Channel:
    """What a channel remembers: its scale, which goes on over reads, and the read that is under way. Plain data, kept as state."""

    def __init__(self, mapper: Mapper):
        self.scale = RollingScale(mapper.tgt_mean, mapper.tgt_stdv)
        self.number, self.open = None, False

    def _begin(self, mapper: Mapper, number: int) -> None:
        self.number, self.open = number, True
        self.samples, self.used, self.chunks, self.end = np.empty(0), 0, 0, None
        self.beam = Beam(mapper.conf)
        self.scale.skip_unread()

    def _close(self, mapper: Mapper, outcome: str) -> dict:
        self.open = False
        found = mapper.located(self.beam.best) if outcome == "mapped" else {}
        length = int(len(self.samples) * BASES_PER_SECOND / SAMPLES_PER_SECOND)
        row = {"number": self.number, "outcome": outcome, "n_chunks": self.chunks, "n_samples": len(self.samples), "n_events": self.beam.events, "at_sample": self.end, "qr_len": length}
        # a closed read needs nothing more
        self.samples, self.beam = np.empty(0), None
        return row | found

    def take(self, mapper: Mapper, number: int, start: int, samples: np.ndarray, max_chunks: int, patience: int = PATIENCE) -> list[dict]:
        """One chunk, and the outcomes that it brings.

        Another read's chunk ends an open read. A chunk of a closed read is dropped. An open read is ended when its chunk
        comes after more than ``patience`` samples. The read's new events are scaled by the channel's window and mapped on
        from where its search stands: it is ``mapped`` once a chain is confident, ``ended`` at the most events, and
        ``gave_up`` after ``max_chunks``.
        """
        out = []
        if self.number != number:
            if self.open:
                out.append(self._close(mapper, "ended"))
            self._begin(mapper, number)
        elif not self.open:
            return out
        elif start - self.end > patience:
            return [self._close(mapper, "ended")]
        self.chunks, self.end = self.chunks + 1, start + len(samples)
        # boundaries of a part are a part of the whole's boundaries, so a read is cut up anew and its new events are taken
        self.samples = np.concatenate((self.samples, samples))
        found = events(self.samples, mapper.conf.segment)
        levels, self.used = np.array([e[2] for e in found[self.used :]]), len(found)
        while len(levels) and self.beam.best is None:
            levels = levels[self.scale.push(levels) :]
            mapper.advance(self.beam, self.scale.pop())
        if self.beam.best is not None:
            out.append(self._close(mapper, "mapped"))
        elif self.beam.events >= mapper.conf.max_events:
            out.append(self._close(mapper, "ended"))
        elif self.chunks >= max_chunks:
            out.append(self._close(mapper, "gave_up"))
        return out


def run_channels(chunks: DataFrame, build: Callable[[], Mapper], name: str, max_chunks: int = 10, patience: int = PATIENCE) -> DataFrame:
    """chunks (channel, number, start_sample, samples), batch or stream, to read outcomes: each channel's chunks are taken by start.

    A read that is still open when its channel's chunks end has no outcome yet. A chunk is handled when it comes, so no
    backlog builds up and none is dropped; there are no wall-clock limits, and results are the same for any cut of a
    stream into batches. ``build`` makes the mapper, once a worker, from bounded inputs.
    """

    if chunks.isStreaming:

        def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            mapper = worker_mapper(build, name)
            channel = pickle.loads(state.get[0]) if state.exists else Channel(mapper)
            out = []
            for r in pd.concat(list(frames)).sort_values(["start_sample", "number"]).itertuples():
                out += channel.take(mapper, int(r.number), int(r.start_sample), np.asarray(r.samples, dtype=float), max_chunks, patience)
            state.update((pickle.dumps(channel),))
            yield pd.DataFrame([{"channel": key[0]} | r for r in out], columns=NAMES, dtype=object)

        return chunks.groupBy("channel").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    schema = to_arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper, now, channel = worker_mapper(build, name), object(), None
        for batch in batches:
            out = []
            cols = [batch.column(c) for c in ("channel", "number", "start_sample", "samples")]
            for key, number, start, samples in zip(*(c.to_pylist() for c in cols[:3]), cols[3], strict=True):
                if key != now:
                    now, channel = key, Channel(mapper)
                out += [{"channel": key} | r for r in channel.take(mapper, number, start, np.array(samples.as_py() or [], dtype=float), max_chunks, patience)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in NAMES} for r in out], schema=schema)

    # a channel's chunks pass through one task in order, a batch at a time: only its state is held
    ordered = chunks.select("channel", "number", "start_sample", "samples").repartition("channel").sortWithinPartitions("channel", "start_sample", "number")
    return ordered.mapInArrow(run, OUT)


def active_reads(chunks: DataFrame, workers: int, width: int) -> DataFrame:
    """(tick, worker, n): channels with a chunk in each stretch of ``width`` samples, by the worker that channels are dealt to."""
    return chunks.groupBy(F.floor(F.col("start_sample") / width).alias("tick"), F.pmod(F.col("channel"), F.lit(workers)).alias("worker")).agg(F.countDistinct("channel").alias("n"))


def tumbling(events: DataFrame, time: str, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window, for batch or stream; timestamps without a zone are read as UTC."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, late)
    return stamped.groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("st"), "n")


def sessions(events: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark(time, "10 minutes")
    return stamped.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("st"), "n")
