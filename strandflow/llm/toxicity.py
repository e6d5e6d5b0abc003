"""Toxicity by weak supervision.

1. A bounded sample of labelled rows of the training folds gives candidate voters: words (lexicon) and word
   prefixes of 4 to 8 characters (patterns) that occur far more often in toxic rows, at most VOTERS of them, and for
   each a second voter that fires on repeated use. Negative voters fire where little or nothing of the lexicon is found.
2. A generative label model (two hidden classes) is fitted by expectation maximisation over the votes of two bounded
   samples, labelled and unlabelled rows of the training folds. It estimates each voter's rate of firing in either
   class; a known label is one more voter, with estimated rates too, which is silent on unlabelled rows. Voters whose
   votes correlate beyond what the classes explain share one vote's weight. ``voters`` returns what it estimated.
3. A logistic regression on the voters' counts is trained on the model's posterior labels of both samples, and scores
   every text.

The samples are the ``sample`` labelled and ``unlabelled_sample`` unlabelled ids with the smallest hash of doc_id;
scoring covers every document.

Edge cases: null and empty texts fire no voter and get the score of that; without labelled rows of both kinds
all scores are 0; repeated rows repeat, and of rows that share a doc_id one text (the smallest) is fitted on; rows with
a null doc_id are scored, never fitted on; of candidate voters that tie, the first in the alphabet is taken; very long
texts are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import bound_batches, fit_logistic, plain, sigmoid, stored
from strandflow.llm.quality_ranker import labelled

SAMPLE, UNLABELLED, VOTERS, PREFIXES = 6000, 4000, 240, (4, 5, 6, 7, 8)
#: A voter is in so many labelled toxic rows at least, and in such a share of them; rarer terms say more of the sample than of the class.
MIN_ROWS, MIN_SHARE, LIFT = 3, 0.02, 6.0
#: Words a term, for the voters on thin use.
THIN = (400, 100, 50)
#: Words whose voters a worker remembers.
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode("utf-8", "replace").lower())


def terms_of(word: str) -> list[str]:
    """A word's own term ("w:") and those of its prefixes ("p:")."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: term, toxic rows and other rows that have it."""
    schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
    for batch in batches:
        found = (Counter(), Counter())
        for y, t in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
            found[y == 1].update({x for w in set(words_of(t.as_py())) for x in terms_of(w)})
        terms = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], schema=schema)


def choose(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """At most VOTERS terms, by log odds times the root of support."""
    terms = sample.select("label", "text").mapInArrow(_term_rows, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = ((F.col("pos") + 0.3) / (n_pos + 1)) / ((F.col("neg") + 0.3) / (n_neg + 1))
    terms = terms.filter(F.col("pos") >= max(MIN_ROWS, MIN_SHARE * n_pos)).withColumn("lift", lift).filter((F.col("lift") >= LIFT) & (F.col("pos") > 0.3 * F.col("neg")))
    return [r[0] for r in terms.orderBy((F.log("lift") * F.sqrt("pos")).desc(), "term").limit(VOTERS).collect()]


class Votes(dict):
    """Word -> numbers of the chosen terms that it fires (none for most), worked out once a word."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(i for t in terms_of(word) if (i := self.number.get(t)) is not None)
        if len(self) < CACHE:
            self[word] = found
        return found

    def counts(self, text: bytes | None) -> tuple[np.ndarray, int, int]:
        """Occurrences of each term, of words with any term, and of all words."""
        words = words_of(text)
        hits = list(filter(None, map(self.__getitem__, words)))
        out = np.zeros(len(self.number))
        for which in hits:
            for i in which:
                out[i] += 1
        return out, len(hits), len(words)


def row_of(counts: np.ndarray, total: int, n: int) -> np.ndarray:
    """Features: log counts, and the hits together by count and by share."""
    return np.concatenate((np.log1p(counts), [np.log1p(total), min(total, 1), min(total, 3) / 3, total / (n + 20.0) * 20, *(float(total * d < n) for d in THIN), 1.0]))


def _vectors(terms: list[str]):
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("counts", pa.binary()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches):
        votes = Votes(terms)
        for batch in batches:
            rows = [votes.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r[0].astype("<f4").tobytes() for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], schema=schema)

    return run


def shared_weight(votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 over the number of voters that a voter moves with, by the squares of the correlations that the class does not explain."""
    c = np.zeros((votes.shape[1], votes.shape[1]))
    for t in (y, 1 - y):
        if t.sum() > 2:
            mean = votes.T @ t / t.sum()
            v = (votes - mean) * np.sqrt(t / t.sum())[:, None]
            cov = v.T @ v
            sd = np.sqrt(np.diag(cov)) + 1e-6
            c = np.maximum(c, cov / np.outer(sd, sd))
    return 1.0 / np.maximum(1.0, (np.clip(c, 0, 1) ** 2).sum(axis=1))


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 20) -> dict:
    """EM over binary votes (rows x voters); ``label`` is 1, 0 or, where unknown, -1.

    Gives ``posterior`` of class 1 per row, ``weight`` per voter (1 over the number of voters that it moves with),
    ``rates`` (firing in class 1 and 0 per voter, the known label last) and ``prior``.
    """
    known = label >= 0
    y = np.where(label == 1, 0.9, np.where(label == 0, 0.05, 0.5))
    if known.any() and not known.all():
        # unknown rows start from the rates among known ones
        p1, p0 = ((votes[known].T @ t + 0.5) / (t.sum() + 1) for t in (y[known], 1 - y[known]))
        llr = votes @ np.log(p1 / p0) + (1 - votes) @ np.log((1 - p1) / (1 - p0))
        prior = y[known].mean()
        y[~known] = sigmoid(llr[~known] / np.sqrt(votes.shape[1]) + np.log(prior / (1 - prior)))
    for _ in range(3):
        weight = shared_weight(votes, y)
        for _ in range(rounds):
            prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
            p1 = (votes.T @ y + 0.5) / (y.sum() + 1)
            p0 = (votes.T @ (1 - y) + 0.5) / ((1 - y).sum() + 1)
            # the known label's rates, from known rows; a label that is right nine times in ten is the prior's guess
            g1 = float((y[known & (label == 1)].sum() + 9) / (y[known].sum() + 10))
            g0 = float(((1 - y)[known & (label == 1)].sum() + 0.5) / ((1 - y)[known].sum() + 10))
            llr = votes @ (weight * np.log(p1 / p0)) + (1 - votes) @ (weight * np.log((1 - p1) / (1 - p0)))
            llr += np.where(label == 1, np.log(g1 / g0), np.where(label == 0, np.log((1 - g1) / (1 - g0)), 0.0))
            before, y = y, sigmoid(llr + np.log(prior / (1 - prior)))
            if np.abs(before - y).max() < 1e-6:
                break
    return {"posterior": y, "weight": weight, "rates": np.stack([np.append(p1, g1), np.append(p0, g0)], axis=1), "prior": prior}


def votes_of(counts: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Binary votes: each term once, each term twice, and what the text holds of all terms together."""
    whole = [total == 0, *(total * d < n for d in THIN), total >= 2, total >= 3]
    return np.concatenate((counts >= 1, counts >= 2, np.stack(whole, axis=1)), axis=1).astype(np.float32)


def names_of(terms: list[str]) -> list[str]:
    return [*terms, *(f"{t} twice" for t in terms), "no term", *(f"under one term in {d} words" for d in THIN), "two terms", "three terms", "known label"]


def fit(counts: np.ndarray, total: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, dict]:
    """Weights of the linear classifier, trained on the label model's posteriors, and the label model."""
    found = label_model(votes_of(counts, total, n), label)
    x = np.stack([row_of(*r) for r in zip(counts, total, n, strict=True)])
    return fit_logistic(x, np.clip(found["posterior"], 0.01, 0.99), l2=2e-4, steps=25), found


def _score(terms: list[str], w: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        votes = Votes(terms)
        for batch in batches:
            rows = [float(row_of(*votes.counts(t.as_py())) @ w) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(np.array(rows, dtype=float)))], schema=schema)

    return run


def unlabelled(docs: DataFrame, labels: DataFrame, folds: int, held: int, sample: int) -> DataFrame:
    """(doc_id, text, label -1) of at most ``sample`` rows outside the held-out fold that have no label: the smallest hashes of doc_id."""
    ids = plain(docs, "doc_id").select(F.col("doc_id").cast("long").alias("lid")).filter("lid is not null").filter(F.crc32(F.col("lid").cast("string")) % folds != held)
    has = labels.filter("toxic is not null").select(F.col("doc_id").cast("long").alias("has")).distinct()
    ids = ids.join(has, F.col("lid") == F.col("has"), "left_anti").distinct().orderBy(F.xxhash64("lid"), "lid").limit(sample)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("lid")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.select("doc_id", F.lit(-1).alias("label"), "text")


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, unlabelled_sample: int = UNLABELLED) -> tuple[list[str], np.ndarray, dict] | None:
    """(terms, weights, label model), or None without labelled rows of both kinds."""
    bound_batches(docs.sparkSession)
    rows = stored(labelled(docs, labels, "toxic", folds, held, sample).select("doc_id", "label", "text"), "labelled")
    n_pos, n_neg = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n_pos or not n_neg:
        return None
    terms = choose(rows, n_pos, n_neg)
    both = rows.union(unlabelled(docs, labels, folds, held, unlabelled_sample))
    found = both.mapInArrow(_vectors(terms), "doc_id long, label int, counts binary, total long, n long").collect()  # at most both samples' rows of VOTERS short numbers
    found.sort(key=lambda r: r[0])
    return terms, *fit(np.frombuffer(b"".join(r[2] for r in found), dtype="<f4").reshape(len(found), -1), *(np.array([r[i] for r in found]) for i in (3, 4, 1)))


def voters(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, unlabelled_sample: int = UNLABELLED) -> DataFrame:
    """What the label model estimated: voter, rate_toxic and rate_clean of firing, weight (under 1 for correlated voters)."""
    spark, made = docs.sparkSession, train(docs, labels, folds, held, sample, unlabelled_sample)
    terms, _, found = made or ([], None, {"rates": np.empty((0, 2)), "weight": np.empty(0)})
    weight = [*found["weight"].tolist(), 1.0]
    rows = [(v, float(a), float(b), w) for v, (a, b), w in zip(names_of(terms), found["rates"], weight, strict=False)]
    return spark.createDataFrame(rows, "voter string, rate_toxic double, rate_clean double, weight double")


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, unlabelled_sample: int = UNLABELLED) -> DataFrame:
    """Per row: doc_id, score, predicted (1 if score >= 0.7)."""
    made = train(docs, labels, folds, held, sample, unlabelled_sample)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if made is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return texts.mapInArrow(_score(*made[:2]), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
