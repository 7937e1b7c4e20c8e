"""Toxicity by maximum-scoring segments.

Every token gets a log-odds score under an informative Dirichlet prior (its background rate), taken
at the lower end of its confidence interval; a token without evidence of its own takes the score of
its 4- or 5-letter stem.  All other tokens score ``-DRIFT``; a repeat scores like the first occurrence, so a
passage counts wherever else its words stand.  A linear-time scan (Ruzzo and Tompa) finds every maximal segment of a text.  Karlin-Altschul parameters, fitted on the clean training texts, turn
a segment's score into an E-value for a text of that length; the sum of ``-ln E`` over the
significant segments (the sum statistic of extreme values) is calibrated to a probability.

Nulls and empty texts: no token, no segment, the score of a text without evidence.  Repeated rows are
scored alike; a text that several labelled rows share is learned once.  Without labels of both classes
every score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Carried, fit_logistic, labelled_sample, map_batches, release_memory, sigmoid, text_of

TOKEN = re.compile(r"[^\W_]+")
DRIFT = 0.5
CONFIDENCE = 2.33       # many thousand tokens are tested at once
LEAST_SCORE = 1.0
SIGNIFICANT = 3.0        # -ln E of a segment that counts (E below 0.05)
STEMS = (5, 4)
ALL = " "                 # not a token: the row that counts all tokens
MAX_TRAIN = 200_000      # labelled rows used to fit, at most
MAX_FEATURES = 50_000    # scored features kept, by score


@dataclass(frozen=True)
class ToxicModel:
    scores: dict          # feature -> score; words as they are, stems as "stem*"
    lam: float
    k: float
    a: float
    b: float

    def token_score(self, token: str) -> float:
        s = self.scores.get(token)
        if s is None:
            for n in STEMS:
                if len(token) > n and (s := self.scores.get(token[:n] + "*")) is not None:
                    return s
            return -DRIFT
        return s


class TokenScores(dict):
    """Remembers the score of each token met, up to a bound."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 150_000:
            self.clear()
        s = self[token] = self.model.token_score(token)
        return s


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a score sequence, in linear time."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    left: list[float] = []
    right: list[float] = []
    start: list[int] = []
    end: list[int] = []
    back: list[int] = []
    for i in at.tolist():
        lo, hi, a = float(total[i]), float(total[i + 1]), i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, a = left[j], start[j]
            for seq in (left, right, start, end):
                del seq[j:]
            nxt = back[j]
            del back[j:]
            j = nxt
        left.append(lo)
        right.append(hi)
        start.append(a)
        end.append(i + 1)
        back.append(j)
    return [(s, e, r - l) for s, e, l, r in zip(start, end, left, right)]


def _features(tokens: set[str]) -> set[str]:
    return tokens | {t[:n] + "*" for t in tokens for n in STEMS if len(t) > n}


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"feature": keys, "n0": [counts[0][k] for k in keys], "n1": [counts[1][k] for k in keys]})
        counts[0].clear()
        counts[1].clear()
        return out

    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            tokens = set(TOKEN.findall(text.lower()))
            counts[label].update(_features(tokens))
            counts[label][ALL] += len(tokens)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def _evidence(model: ToxicModel):
    """Per text: the statistic T, the number of significant segments, these segments."""
    cache = TokenScores(model)

    def of(text: str) -> tuple[float, int, list]:
        tokens = TOKEN.findall(text.lower())
        if not tokens:
            return 0.0, 0, []
        scores = np.fromiter(map(cache.__getitem__, tokens), float, len(tokens))
        found = maximal_segments(scores)
        if not found:
            return 0.0, 0, []
        log_kn = np.log(model.k * len(tokens))
        t, kept = 0.0, []
        for s, e, score in found:
            x = model.lam * score - log_kn
            if x > SIGNIFICANT:
                t += x
                kept.append((s, e, x))
        return t, len(kept), kept

    return of


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, max_train: int = MAX_TRAIN,
        max_features: int = MAX_FEATURES) -> ToxicModel:
    """Learn from ``labels`` (doc_id, toxic) of the rows where ``learn`` holds, at most ``max_train`` of them."""
    learn = F.lit(True) if learn is None else learn
    sample = materialize(labelled_sample(docs, labels, "toxic", learn, max_train), "toxic_train")
    train = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return ToxicModel({}, 1.0, 1.0, float(np.log((n1 + 0.5) / (n0 + 0.5))), 0.0)
    counts = (map_batches(train.select("text", "label"), _count_features, "feature string, n0 long, n1 long")
              .groupBy("feature").agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1")))
    alpha = max(10.0, 0.005 * (n0 + n1))
    prior = alpha * (F.col("n0") + F.col("n1")) / float(n0 + n1)
    odds = F.log((F.col("n1") + prior) / (n1 + alpha)) - F.log((F.col("n0") + prior) / (n0 + alpha))
    doubt = F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior))
    scored = materialize(counts.select(
        "feature", "n0", "n1", (odds - CONFIDENCE * doubt).alias("score")).where(
        (F.col("score") > LEAST_SCORE) | (F.col("feature") == ALL)), "toxic_terms")
    total = scored.where(F.col("feature") == ALL).first() or {"n0": 0.0}
    top = scored.where(F.col("feature") != ALL).orderBy(F.desc("score"), "feature").limit(max_features).collect()
    scores = {r["feature"]: float(r["score"]) for r in top}
    # Karlin-Altschul parameters from the clean training texts; then the calibration of T
    lam, k = karlin_altschul(np.array([scores[r["feature"]] for r in top]), np.array([r["n0"] for r in top]),
                             total["n0"])
    second = ToxicModel(scores, lam, k, 0.0, 0.0)

    def statistics(batches):
        of = _evidence(second)
        for pdf in batches:
            yield pd.DataFrame({"t": [round(min(of(x)[0], 200.0), 1) for x in pdf["text"]], "label": pdf["label"]})

    bins = (map_batches(train.select("text", "label"), statistics, "t double, label int")
            .groupBy("t").agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0")).collect())
    a, b = fit_logistic(np.array([r["t"] for r in bins]), np.array([float(r["y1"]) for r in bins]),
                        np.array([float(r["y0"]) for r in bins]))
    return ToxicModel(scores, lam, k, a, b)


def karlin_altschul(s: np.ndarray, n: np.ndarray, total: float) -> tuple[float, float]:
    """Lambda solves sum p(s) exp(lambda s) = 1 over the tokens of clean texts; K matches their rate of positive
    scores.  s, n: the positive scores and how often clean texts have them; total: all their tokens."""
    if not total or not len(s):
        return 1.0, 1.0
    mid = float(np.median(s))
    positive = min(float(n.sum()), total)
    s = np.concatenate((s, [mid, -DRIFT]))
    p = np.concatenate((n, [1.0, total - positive])) / (total + 1)   # one positive token more than was seen
    if (s * p).sum() >= 0:
        return 0.05, 1.0
    lo, hi = 1e-6, 50.0 / mid
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if (p * np.exp(np.minimum(x * s, 700))).sum() < 1 else (lo, x)
    rate = p[s > 0].sum()
    return lo, float(min(1.0, max(1e-12, rate * np.exp(lo * s[s > 0].min()))))


RESULTS = ("score", "predicted", "evidence", "n_segments", "starts", "ends")


def _scored(docs: DataFrame, model: ToxicModel, carried: Carried) -> DataFrame:
    """The carried columns and :data:`RESULTS`, each under a name of its own."""
    shared, own = docs.sparkSession.sparkContext.broadcast(model), carried.own

    def run(batches):
        m = shared.value
        of = _evidence(m)
        for pdf in batches:
            found = [of(x) for x in pdf["text"]]
            t = np.array([x[0] for x in found], dtype=float)
            p = sigmoid(m.a + m.b * np.minimum(t, 200.0))
            yield pd.DataFrame({c: pdf[c] for c in own} | {
                "score": p, "predicted": (p >= 0.5).astype("int32"), "evidence": t,
                "n_segments": np.array([x[1] for x in found], dtype="int32"),
                "starts": [[s for s, _, _ in x[2]] for x in found], "ends": [[e for _, e, _ in x[2]] for x in found]})
        release_memory()

    return map_batches(docs.select(*carried.columns, text_of().alias("text")), run,
                       f"{carried.schema}, score double, predicted int, evidence double, n_segments int, starts array<int>, ends array<int>")


def score(docs: DataFrame, model: ToxicModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and score, predicted, evidence (sum of -ln E), n_segments, and the token
    spans (starts, ends) of the significant segments.  A kept column with the name of a result is left out."""
    carried = Carried(docs, keep)
    return _scored(docs, model, carried).select(*carried.back(without=RESULTS), *RESULTS)


def without_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever these are called."""
    carried = Carried(docs, docs.columns)
    return _scored(docs, model, carried).where("predicted = 0").select(*carried.back())
