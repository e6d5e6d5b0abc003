"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (quality 1 over quality 0); the logistic loss on their feature
differences gives one weight a feature and so a score for each document. Documents are then kept above a
quantile of the scores of all documents. Its level is the share of low documents in this corpus: the labels give the
odds of low quality at a score, and expectation maximisation over the scores of all documents (a histogram of BINS
counts) moves the labels' share to the corpus's own (prior shift). The reported score is the logistic of the distance to
the quantile, shifted so that the quantile is at 0.7.

At most ``sample`` labelled ids (those with the smallest hash of doc_id) are used to fit; scores, the share and the
quantile cover every document.

Edge cases: null and empty texts have all features 0 and are scored by the model like others; without labelled
rows of both kinds every document gets score 1 (kept); documents of equal score are kept or dropped together (a quantile
between two scores lies in the middle of the gap); repeated rows repeat, and of rows that share a labelled doc_id one
text (the smallest) is fitted on; rows with a null doc_id are scored, never fitted on; very long texts are measured
whole; an empty table gives an empty result; other columns are ignored, whatever their names (``keep_good`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strandflow.llm.common import bound_batches, fit_logistic, plain, sigmoid, stored, unpacked

SAMPLE, PAIRS, CUT, BINS = 6000, 60_000, 0.7, 2000
_LOWER_AZ = bytes(range(97, 123))
_UPPER_AZ = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"


def features(text: bytes | None) -> list[float]:
    """Shares and log counts of one text; none of them looks at ids, sources or languages."""
    t = text or b""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * 14
    gone = lambda chars: len(t) - len(t.translate(None, chars))
    letters_low, letters_up = gone(_LOWER_AZ), gone(_UPPER_AZ)
    windows = n - 4
    again = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / windows if windows > 0 else 0.0  # noqa: B905
    lines = [x for x in t.split(b"\n") if x.strip()]
    symbols = gone(_SYMBOLS) / n
    shout = t.count(b"!") / n
    upper = letters_up / (letters_up + letters_low + 1)
    same = sum(map(eq, words, words[1:])) / n
    return [
        min(symbols, 2.0), min(symbols, 0.3), min(shout, 2.0), min(shout, 0.3), upper, min(upper, 0.2),
        same, min(same, 0.1), again, min(again, 0.2), (len(lines) - len(set(lines))) / len(lines),
        len(set(words)) / n, min(len(t) / n, 30.0) / 10, 1 / (1 + n),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))], schema=schema)


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> dict | None:
    """Weights and centre of the features, the labels' share of low documents, their odds line over the score, and the range of scores."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = fit_logistic(z[better] - z[worse], np.ones(pairs), l2=1e-3)
    s = z @ w
    spread = float(np.subtract(*np.quantile(s, [0.95, 0.05]))) or 1.0
    line = fit_logistic(np.stack([s / spread, np.ones(len(s))], axis=1), (label == 0).astype(float), l2=1e-4)
    return {"w": w / scale, "c": float(centre @ (w / scale)), "share": len(bad) / len(s), "slope": float(line[0]) / spread, "bias": float(line[1]), "low": float(s.min()), "high": float(s.max()), "spread": spread}


def low_share(model: dict, at: np.ndarray, n: np.ndarray, rounds: int = 200) -> float:
    """The share of low documents among ``n`` documents at scores ``at``, by EM from the labels' share and odds."""
    share = base = model["share"]
    odds = model["slope"] * at + model["bias"]
    for _ in range(rounds):
        shift = np.log(share / (1 - share)) - np.log(base / (1 - base))
        new = float((n * sigmoid(odds + shift)).sum() / n.sum())
        new = min(max(new, 1e-9), 1 - 1e-9)
        if abs(new - share) < 1e-12:
            break
        share = new
    return share


def quantile(edges: np.ndarray, n: np.ndarray, level: float) -> float:
    """The score under which a share ``level`` of the documents lies: the middle of the edges that come nearest to it."""
    below = np.concatenate(([0], np.cumsum(n)))
    off = np.abs(below - level * n.sum())
    near = np.flatnonzero(off == off.min())
    return float((edges[near[0]] + edges[near[-1]]) / 2)


def _score(model: dict, rest: list[str]):
    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(model["w"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x @ model["w"] - model["c"]), *map(batch.column, rest)], names=["doc_id", "raw", *rest])

    return run


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, sample: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows outside the held-out fold: the smallest hashes of doc_id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col(column).cast("int").alias("label")).filter("lid is not null and label is not null")
    ids = ids.filter(F.crc32(F.col("lid").cast("string")) % folds != held).groupBy("lid").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("lid"), "lid").limit(sample)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # one text an id, so that the bound holds for rows too
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("lid")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return found.select("doc_id", "text", "label")


def rank(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """Per row: doc_id, raw (Bradley-Terry score), score (0 to 1), predicted (1 if score >= 0.7); with ``carry`` the input's columns as ``row``."""
    bound_batches(docs.sparkSession)
    rows = labelled(docs, labels, "quality", folds, held, sample).select("doc_id", "label", "text").mapInArrow(_measure, "doc_id long, label int, x array<double>").collect()  # at most ``sample`` short rows
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    model = fit(np.array([r[2] for r in rows]).reshape(len(rows), -1), np.array([r[1] for r in rows])) if rows else None
    rest = ["row"] if carry else []
    texts = plain(docs, "doc_id", "text", carry=carry).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *rest)
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("raw"), F.lit(1.0).alias("score"), F.lit(1).alias("predicted"), *rest)
    schema = StructType([StructField("doc_id", LongType()), StructField("raw", DoubleType()), *[texts.schema[c] for c in rest]])
    scored = stored(texts.mapInArrow(_score(model, rest), schema), "scores")
    width = (model["high"] - model["low"]) / BINS or 1.0
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") - model["low"]) / width))).cast("int")
    counts = np.zeros(BINS)
    for at, n in scored.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most BINS rows
        counts[at] = n
    edges = model["low"] + width * np.arange(BINS + 1)
    # no score lies under the first edge or over the last: the ends' bins hold what does
    cut = quantile(edges, counts, low_share(model, (edges[1:] + edges[:-1]) / 2, counts)) if counts.any() else edges[0]
    shift = float(np.log(CUT / (1 - CUT)))
    above = F.col("raw") >= F.lit(cut) if cut > edges[0] else F.lit(True)
    z = (F.col("raw") - F.lit(cut)) * F.lit(6.0 / model["spread"]) + F.lit(shift)
    score = F.when(above, F.greatest(F.lit(CUT), 1 / (1 + F.exp(-z)))).otherwise(F.least(F.lit(CUT - 1e-9), 1 / (1 + F.exp(-F.greatest(z, F.lit(-700.0))))))
    return scored.select("doc_id", "raw", score.alias("score"), *rest).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The documents with predicted 1, with the input's columns; each row is judged by its own text, whatever its doc_id."""
    return unpacked(rank(docs, labels, folds, held, carry=True).filter("predicted <> 0"), docs)
