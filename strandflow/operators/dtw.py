"""Dynamic time warping of a signal against a row of k-mer levels (Arrow UDF; the matrix is filled by anti-diagonals)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import kmers as K
from strandflow.operators.segment import SegmentConfig, events


@dataclass(frozen=True)
class DtwConfig:
    diagonal: float = 1.0
    horizontal: float = 1.0
    vertical: float = 1.0
    #: "none": both ends are fixed; "col": any part of the columns' input; "row": any part of the rows'
    free: str = "none"


EVENT_GLOBAL, EVENT_COLUMNS, EVENT_ROWS = DtwConfig(2, 1, 100), DtwConfig(2, 1, 100, "col"), DtwConfig(2, 1, 100, "row")
RAW_GLOBAL, RAW_COLUMNS, RAW_ROWS = DtwConfig(10, 1, 1000), DtwConfig(10, 1, 1000, "col"), DtwConfig(10, 1, 1000, "row")


def warp(cost: np.ndarray, conf: DtwConfig = DtwConfig()) -> tuple[float, list[tuple[int, int]]]:
    """Least total cost and its path of (row, column) pairs; of equal ways a diagonal step goes first, then a horizontal one."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    if conf.free == "col":
        total[0, :] = 0.0
    elif conf.free == "row":
        total[:, 0] = 0.0
    back = np.zeros((n + 1, m + 1), dtype=np.int8)
    for d in range(2, n + m + 1):
        r = np.arange(max(1, d - m), min(n, d - 1) + 1)
        c = d - r
        local = cost[r - 1, c - 1]
        ways = np.stack((total[r - 1, c - 1] + conf.diagonal * local, total[r, c - 1] + conf.horizontal * local, total[r - 1, c] + conf.vertical * local))
        back[r, c] = best = ways.argmin(axis=0)
        total[r, c] = ways[best, np.arange(len(r))]
    i, j = n, m
    if conf.free == "col":
        j = 1 + int(total[n, 1:].argmin())
    elif conf.free == "row":
        i = 1 + int(total[1:, m].argmin())
    score, path = float(total[i, j]), []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        step = back[i, j]
        i, j = i - (step != 1), j - (step != 2)
    return score, path[::-1]


def difference(levels: np.ndarray, stdv: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return np.abs(levels - x)


def unlikeliness(levels: np.ndarray, stdv: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Minus the log density of samples under the levels' Gaussians."""
    sd = np.ones_like(levels) if stdv is None else stdv
    return (x - levels) ** 2 / (2 * sd * sd) + np.log(np.sqrt(2 * np.pi) * sd)


def warp_score(levels: np.ndarray, stdv: np.ndarray | None, x: np.ndarray, cost=difference, conf: DtwConfig = DtwConfig()) -> tuple[float, int]:
    """The score and path length that ``warp`` finds (rows are levels), holding three anti-diagonals only, so inputs may be of any length."""
    n, m = len(levels), len(x)
    edge = lambda free: 0.0 if conf.free == free else np.inf
    # the diagonals before, by row: costs and lengths of the best ways
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    two_len, one_len = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    two[0], one[0], one[1] = 0.0, edge("col"), edge("row")
    best, length = np.inf, 0
    for d in range(2, n + m + 1):
        a, b = max(1, d - m), min(n, d - 1) + 1
        rows = slice(a, b)
        local = cost(levels[a - 1 : b - 1], None if stdv is None else stdv[a - 1 : b - 1], x[d - b : d - a][::-1])
        ways = np.stack((two[a - 1 : b - 1] + conf.diagonal * local, one[rows] + conf.horizontal * local, one[a - 1 : b - 1] + conf.vertical * local))
        which = ways.argmin(axis=0)
        new, new_len = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        at = np.arange(b - a)
        new[rows] = ways[which, at]
        new_len[rows] = 1 + np.stack((two_len[a - 1 : b - 1], one_len[rows], one_len[a - 1 : b - 1]))[which, at]
        if d <= m:
            new[0] = edge("col")
        if d <= n:
            new[d] = edge("row")
        # ends of the path: the last row, the last column or both
        end = n if conf.free == "col" and d > n else d - m if conf.free == "row" and d > m else n if d == n + m else 0
        if end and (new[end] < best or conf.free == "none"):
            best, length = float(new[end]), int(new_len[end])
        two, one, two_len, one_len = one, new, one_len, new_len
    return best, length


def align(pairs: DataFrame, conf: DtwConfig = DtwConfig(), cost=difference, stdv: str | None = None) -> DataFrame:
    """pairs (id, signal, levels) to (id, score, mean_score, path_length). ``cost`` is ``difference`` or ``unlikeliness``, which takes a column ``stdv`` of the levels' deviations."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("mean_score", pa.float64()), ("path_length", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, x, y, sd in zip(batch.column("id").to_pylist(), batch.column("signal").to_pylist(), batch.column("levels").to_pylist(), batch.column("sd").to_pylist(), strict=True):
                if not x or not y:
                    rows.append((i, None, None, None))
                    continue
                score, length = warp_score(np.array(y, dtype=float), None if sd is None else np.array(sd, dtype=float), np.array(x, dtype=float), cost, conf)
                rows.append((i, score, score / length, length))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return pairs.selectExpr("cast(id as bigint) id", "cast(signal as array<double>) signal", "cast(levels as array<double>) levels", f"cast({stdv or 'null'} as array<double>) sd").mapInArrow(run, "id long, score double, mean_score double, path_length long")


def kept_events(levels: np.ndarray, length: int = 25, least: float = 5.0) -> np.ndarray:
    """Which of a whole read's events no still window holds: windows of ``length`` events with a standard deviation under ``least``.

    An event before the last ``length`` ones is judged by the windows that end after it, the others by those that end from it on.
    """
    n = len(levels)
    still = np.zeros(n, dtype=bool)
    for j in range(length // 2, n):
        still[j] = levels[max(0, j - length + 1) : j + 1].std() < least
    return np.array([not (still[p + 1 : p + length] if p <= n - length else still[p:]).any() for p in range(n)], dtype=bool)


def warp_reads(reads: DataFrame, queries: DataFrame, refs: DataFrame, mean: np.ndarray, conf: DtwConfig = EVENT_COLUMNS, k: int = 5, by_event: bool = True, stdv: np.ndarray | None = None) -> DataFrame:
    """Each query's span of a read warped onto the levels of its reference span: (rd_name, rf_name, rf_st, score, mean_score, path_length).

    ``reads``: read_id, signal; ``queries``: as ``read_dtw_queries`` gives them (both read ends 0: the whole read; end 0:
    to its end); ``refs``: name, seq; ``mean``: the model's 4^k levels; with ``stdv``, its deviations, the cost is unlikeliness. The signal, or its events without still ones, is
    scaled to the mean and deviation of the span's levels. Spans without a k-mer and empty signals have null scores.
    """
    x = queries.join(reads.select(F.col("read_id").cast("string").alias("_r"), "signal"), F.col("rd_name") == F.col("_r"))
    x = x.join(refs.select(F.col("name").alias("_n"), "seq"), F.col("rf_name") == F.col("_n"))
    span = F.substr("seq", (F.col("rf_st") + 1).cast("int"), (F.col("rf_en") - F.col("rf_st")).cast("int"))
    codes = lambda s: F.transform(K.kmers(s, k), lambda m: K.encode(m))
    to = F.when(F.col("rd_en") == 0, F.size("signal")).otherwise(F.col("rd_en"))
    part = F.slice("signal", (F.col("rd_st") + 1).cast("int"), F.greatest(to - F.col("rd_st"), F.lit(0)).cast("int"))
    x = x.select("rd_name", "rf_name", "rf_st", codes(F.when(F.col("strand") == "-", K.reverse_complement(span)).otherwise(span)).alias("codes"), part.cast("array<double>").alias("part"))
    kinds = [("score", pa.float64()), ("mean_score", pa.float64()), ("path_length", pa.int64())]
    keys = ["rd_name", "rf_name", "rf_st"]
    schema = pa.schema([("rd_name", pa.string()), ("rf_name", pa.string()), ("rf_st", pa.int64()), *kinds])

    def score(codes: list | None, part: list | None) -> tuple:
        if not codes or None in codes or not part:
            return None, None, None
        y, found = mean[np.array(codes)], np.array(part)
        if by_event:
            found = np.array([e[2] for e in events(found, SegmentConfig())])
            found = found[kept_events(found)] if len(found) else found
        if not len(found):
            return None, None, None
        sd = found.std()
        found = (found - found.mean()) * (y.std() / sd if sd > 0 else 1.0) + y.mean()
        total, length = warp_score(y, None if stdv is None else stdv[np.array(codes)], found, difference if stdv is None else unlikeliness, conf)
        return total, total / length, length

    def run(batches):
        for batch in batches:
            rows = [score(c, s.as_py()) for c, s in zip(batch.column("codes").to_pylist(), batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)]], schema=schema)

    x = x.select(F.col("rd_name").cast("string").alias("rd_name"), F.col("rf_name").cast("string").alias("rf_name"), F.col("rf_st").cast("long").alias("rf_st"), "codes", "part")
    return x.mapInArrow(run, "rd_name string, rf_name string, rf_st long, score double, mean_score double, path_length long")
