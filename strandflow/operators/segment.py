"""Event segmentation by two coupled peak searches (Arrow UDF: each peak depends on the one before).

The t statistic with half-windows 3 and 6 is searched for peaks: one opens where the statistic stands ``height`` above
the lowest value since the last one, and is over when it has fallen ``height`` below a highest value over its threshold
and half its window has passed. Strong peaks of the short statistic silence the long one. Boundaries of a prefix of a
signal are a prefix of its boundaries, so a read can be segmented as its samples come.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SegmentConfig:
    short: int = 3
    long: int = 6
    short_threshold: float = 1.4
    long_threshold: float = 9.0
    height: float = 0.2
    min_mean: float = 0.0
    max_mean: float = 400.0


def statistic(x: np.ndarray, half: int) -> np.ndarray:
    """t at each split, 0 where a side is short."""
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    t = np.zeros(len(x))
    i = np.arange(half, len(x) - half + 1)
    if len(i):
        m1, m2 = (s[i] - s[i - half]) / half, (s[i + half] - s[i]) / half
        var = (q[i + half] - q[i - half]) / half - m1 * m1 - m2 * m2
        t[i] = np.abs(m2 - m1) / np.sqrt(np.maximum(var, 1e-30) / half)
    return t


def _opening(t: list[float], at: int, stop: int, floor: float, height: float) -> int:
    """The first place in [at, stop) where t stands over ``height`` above all values before it (``floor`` and t from ``at``); stop if none."""
    for i in range(at, stop):
        if t[i] < floor:
            floor = t[i]
        elif t[i] - floor > height:
            return i
    return stop


def _summit(t: list[float], at: int, stop: int, threshold: float, height: float, wait: int) -> tuple[int, list[tuple[int, int]]]:
    """From an opening: the step at which the peak is over (stop if it never is), and the strong steps on the way.

    It is over once t has been over ``height`` under a highest value above the threshold, and over ``wait`` steps have
    passed since the highest. A step is strong from the first highest value above the threshold on: (step, place of the highest).
    """
    place, fallen, strong = at, False, []
    for i in range(at, stop):
        if t[i] > t[place]:
            place = i
        if t[place] > threshold:
            strong.append((i, place))
            fallen = fallen or t[place] - t[i] > height
        if fallen and i - place > wait:
            return i, strong
    return stop, strong


def _peaks(t: list[float], at: int, stop: int, threshold: float, height: float, half: int):
    """The peaks of t in [at, stop) as (end, strong steps); each is searched for from the end of the one before, whose value is the floor."""
    floor = np.inf
    while (opened := _opening(t, at, stop, floor, height)) < stop:
        end, strong = _summit(t, opened, stop, threshold, height, half // 2)
        yield end, strong
        if end == stop:
            return
        at, floor = end + 1, t[end]


def boundaries(x: np.ndarray, conf: SegmentConfig = SegmentConfig()) -> list[int]:
    """Starts of events, 0 first. An event ends two samples before the step at which a peak of either statistic is over.

    Peaks of the short statistic come first, as they depend on nothing else. Each of their steps above the threshold
    starts the search on the long statistic anew, half a short window after the place of the peak at the earliest; so
    the long statistic is searched stretch by stretch between such steps.
    """
    n = max(0, len(x) - conf.long + 1)
    ts, tl = statistic(x, conf.short)[:n].tolist(), statistic(x, conf.long)[:n].tolist()
    ends: set[int] = set()
    anew = [(1, 1)]  # (step, first step that counts after it)
    for end, strong in _peaks(ts, 1, n, conf.short_threshold, conf.height, conf.short):
        ends.add(end)
        anew += [(step, max(step, place + conf.short + 1)) for step, place in strong]
    for (_, begin), (stop, _) in zip(anew, [*anew[1:], (n, n)], strict=True):
        if stop - begin > conf.long // 2:
            ends.update(end for end, _ in _peaks(tl, begin, stop, conf.long_threshold, conf.height, conf.long) if end < stop)
    ends.discard(n)
    out = [0]
    for at in sorted(ends):
        if at - conf.short + 1 > out[-1]:
            out.append(at - conf.short + 1)
    return out


def mean_event_length(x: np.ndarray, conf: SegmentConfig = SegmentConfig(), cuts: list[int] | None = None) -> float | None:
    """Mean length of all events that were closed, those with a mean outside the limits too. ``cuts``: the boundaries, if known."""
    cuts = boundaries(x, conf) if cuts is None else cuts
    return float(np.mean(np.diff(cuts))) if len(cuts) > 1 else None


def events(x: np.ndarray, conf: SegmentConfig = SegmentConfig(), cuts: list[int] | None = None) -> list[tuple[int, int, float, float]]:
    """(start, length, mean, stdv); the last open segment is left out, means outside the limits are dropped. ``cuts``: the boundaries, if known."""
    cuts = np.array(boundaries(x, conf) if cuts is None else cuts)
    if len(cuts) < 2:
        return []
    size, part = np.diff(cuts), x[: cuts[-1]]
    mean = np.add.reduceat(part, cuts[:-1]) / size
    stdv = np.sqrt(np.add.reduceat((part - np.repeat(mean, size)) ** 2, cuts[:-1]) / size)
    rows = zip(cuts[:-1].tolist(), size.tolist(), mean.tolist(), stdv.tolist(), strict=True)
    return [r for r in rows if conf.min_mean <= r[2] <= conf.max_mean]


def segment(reads: DataFrame, conf: SegmentConfig = SegmentConfig()) -> DataFrame:
    """reads (read_id, signal) to (read_id, evt, start, length, mean, stdv). Null and empty signals have no events."""
    kind = reads.schema["read_id"].dataType
    schema = pa.schema([("read_id", pa.int64()), ("evt", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("mean", pa.float64()), ("stdv", pa.float64())])

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for read, x in zip(batch.column("read_id").to_pylist(), batch.column("signal"), strict=True):
                found = events(np.array(x.as_py() or [], dtype=float), conf)
                ids += [read] * len(found)
                rows += [(i, *e) for i, e in enumerate(found)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate(cols)]], schema=schema)

    out = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("signal").cast("array<double>").alias("signal")).mapInArrow(run, "read_id long, evt long, start long, length long, mean double, stdv double")
    return out.withColumn("read_id", F.col("read_id").cast(kind))
