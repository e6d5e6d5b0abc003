"""Search for a preset: probability thresholds by match count that reach a target speed or probability.

Spark counts how match counts fall along extended matches; what is left is a matrix of at most 64 rows by the longest
usual match, and the search itself is arithmetic on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators.index import repeats, self_align


def extensions(seqs: DataFrame, by: str, first: int, most: int, sample: int = 1) -> DataFrame:
    """(by, pos, step, copies): the match from each sampled place as it grows from ``first`` bases, up to and including the step at which it is alone."""
    grown = self_align(seqs, list(range(first, most + 1)), sample, by).withColumn("step", F.col("len") - first)
    alone = grown.filter("copies = 1").groupBy(by, "pos").agg(F.min("step").alias("_end"))
    return grown.join(alone, [by, "pos"], "left").filter("_end is null or step <= _end").select(by, "pos", "step", "copies")


def profile(grown: DataFrame, by: str, rare: float = 0.05) -> np.ndarray:
    """Counts by floor(log2 copies) and step, over the steps that more than ``rare`` of the matches reach. Ended matches count as alone."""
    ends = grown.groupBy(by, "pos").agg((F.max("step") + 1).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    lengths = sorted((r[0], r[1]) for r in ends.collect())  # one row a length
    if not lengths:
        return np.zeros((1, 1))
    total = sum(c for _, c in lengths)
    reach = [sum(c for n, c in lengths if n > i) for i in range(lengths[-1][0])]
    steps = next((i for i, r in enumerate(reach) if r / total <= rare), lengths[-1][0]) or 1
    bins = (F.char_length(F.bin("copies")) - 1).cast("int")
    cells = grown.filter(F.col("step") < steps).groupBy(bins.alias("b"), "step").agg(F.count(F.lit(1)).alias("c")).collect()  # at most 64 bins by ``steps``
    out = np.zeros((max(r[0] for r in cells) + 1, steps))
    for b, i, c in cells:
        out[b, i] = c
    for n, c in lengths:
        out[0, min(n, steps) :] += c
    return out


def model_table(mean: np.ndarray, stdv: np.ndarray, grid: np.ndarray, points: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """For each threshold of ``grid``: the share of events that pass it on their own k-mer, and the mean number of k-mers that an event passes it on.

    The share is exact; for the number, events stand at ``points`` even quantiles of each k-mer's Gaussian.
    """
    log_den = np.log(np.sqrt(2 * np.pi) * stdv)
    widths, many = np.unique(log_den, return_counts=True)
    inside = lambda t, w: erf(sqrt(max(0.0, -(t + w))))
    own = np.array([sum(m * inside(t, w) for w, m in zip(widths, many, strict=True)) for t in grid]) / len(mean)
    seen = np.zeros(len(grid))
    for i in range(points):
        x = mean + NormalDist().inv_cdf((i + 0.5) / points) * stdv
        p = -((x[:, None] - mean) ** 2) / (2 * stdv * stdv) - log_den
        seen += np.searchsorted(np.sort(p, axis=None), grid)
    n = len(mean) * points
    return own, (n * len(mean) - seen) / n


@dataclass(frozen=True)
class Preset:
    thresholds: list[float]
    prob: float
    speed: float
    exponent: float


class Search:
    """Presets over a profile and a model table (thresholds ascending, own-match shares and match counts descending)."""

    def __init__(self, counts: np.ndarray, thresholds: np.ndarray, own: np.ndarray, matches: np.ndarray, low: float = 0.6, high: float = 0.9995):
        steps = np.arange(counts.shape[1])
        share = lambda x, axis: x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)
        #: mean step of each bin, and mean bin of each step
        self.step_of = share(counts, 1) @ steps
        self.bin_of = np.arange(len(counts)) @ share(counts, 0)
        self.steps, self.low, self.high = steps, low, high
        self.alone = np.arange(np.round(self.step_of[0]))
        # np.interp wants rising places
        self.own, self.matches, self.thresholds = own[::-1], matches[::-1], thresholds[::-1]

    def curve(self, exponent: float) -> tuple[np.ndarray, np.ndarray]:
        t = np.linspace(0, 1, 100)
        return t * self.step_of[0], self.low + t**exponent * (self.high - self.low)

    def prob(self, exponent: float) -> float:
        """Chance that a match passes at every step until it is alone."""
        return float(np.prod(np.interp(self.alone, *self.curve(exponent))))

    def speed(self, exponent: float) -> float:
        """Mean number of k-mers that pass, weighted by how repetitive the steps are."""
        passed = np.interp(np.interp(self.steps, *self.curve(exponent)), self.own, self.matches)
        return float(passed @ self.bin_of / max(self.bin_of.sum(), 1e-300))

    def find(self, prob: float | None = None, speed: float | None = None, close: float = 1e-5) -> Preset:
        """Both measures fall with the exponent, so it is bracketed by doubling or halving and then bisected; a target out of reach gives the nearest end."""
        if (prob is None) == (speed is None):
            raise ValueError("one target is needed")
        over = lambda e: self.prob(e) - prob if speed is None else self.speed(e) - speed
        lo = hi = 2.0
        while over(lo) < 0 and lo > 1e-6:
            lo /= 2
        while over(hi) > 0 and hi < 1e6:
            hi *= 2
        e = lo if over(lo) < 0 else hi if over(hi) > 0 else (lo + hi) / 2
        while lo < e < hi and abs(over(e)) > close:
            lo, hi = (e, hi) if over(e) > 0 else (lo, e)
            e = (lo + hi) / 2
        limits = np.interp(np.interp(self.step_of, *self.curve(e)), self.own, self.thresholds)
        return Preset([float(x) for x in limits], self.prob(e), self.speed(e), e)


def usual_match(seqs: DataFrame, by: str, first: int, rare: float = 0.05) -> int:
    """A match length at which at most a share ``rare`` of all places is not alone yet (the longest sequence where there is none): ``profile`` looks no further."""
    longest = seqs.agg(F.max(F.char_length("seq"))).first()[0] or 0
    most = first + 3
    while most < longest:
        n, shared = repeats(seqs, most, by).agg(F.count(F.lit(1)), F.count_if(F.col("copies") > 1)).first()
        if shared <= rare * n:
            break
        most = 2 * most - first
    return most + 1


def search_presets(seqs: DataFrame, by: str, mean: np.ndarray, stdv: np.ndarray, targets: dict[str, dict], first: int = 5) -> DataFrame:
    """(name, thresholds, prob, speed), one row for each target (``{"speed": 115.0}`` or ``{"prob": 0.3}``)."""
    counts = profile(extensions(seqs, by, first, usual_match(seqs, by, first)), by)
    grid = np.linspace(-12.0, -0.5, 200)
    found = Search(counts, grid, *model_table(mean, stdv, grid))
    rows = [(n, p.thresholds, p.prob, p.speed) for n, t in targets.items() for p in [found.find(**t)]]
    return seqs.sparkSession.createDataFrame(rows, "name string, thresholds array<double>, prob double, speed double")


def overall(passes: DataFrame, by: str) -> DataFrame:
    """(by, prob, speed) of passes (share, weight, matches): the product of the shares, and the weighted mean of the matches."""
    return passes.groupBy(by).agg(F.exp(F.sum(F.log("share"))).alias("prob"), (F.sum(F.col("weight") * F.col("matches")) / F.sum("weight")).alias("speed"))
