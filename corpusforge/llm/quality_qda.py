"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a vector of transformed statistics (logs of counts, arc-sines of shares).  Per class a
mean and a covariance are summed up by Spark; the covariance is shrunk towards the pooled one and
towards a sphere; its Cholesky factor is computed once and kept in the model.  A text's score is the
difference of the Mahalanobis log densities, calibrated on the training rows.

Nulls and empty texts give the vector of zero counts and a score like any other.  Repeated rows score
alike.  Without labels of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fit_logistic, labelled_sample, map_batches, sigmoid, text_of

MAX_TRAIN = 200_000
TO_POOLED, TO_SPHERE = 0.10, 0.02
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\W\d_]")
DIGIT = re.compile(r"\d")
SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=+@/]")
SHOUT = re.compile(r"[!?]")
STOP_PUNCT = re.compile(r"[.,;:]")
CASED = re.compile(r"[A-ZÀ-ÖØ-Þ]")
N_FEATURES = 18


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text."""
    words = WORD.findall(text)
    n, n_chars = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    in_words = sum(map(len, words))
    pairs = Counter(zip(words, words[1:]))

    def share(k: float, of: float) -> float:
        return float(np.arcsin(np.sqrt(min(1.0, k / of)))) if of else 0.0

    top = max(counts.values(), default=0)
    repeats = sum(v - 1 for v in pairs.values())
    same = sum(a == b for a, b in zip(words, words[1:]))
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values()) if n else 0.0
    tidy = sum(w[-1].isalnum() or w[-1] in ".,;:" for w in words)
    return [
        np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines) if lines else 0.0),
        np.log1p(in_words / n if n else 0.0),
        share(len(counts), n), share(top, n), share(repeats, max(n - 1, 0)), share(same, max(n - 1, 0)),
        entropy / np.log2(n + 2),
        share(len(LETTER.findall(text)), n_chars), share(len(DIGIT.findall(text)), n_chars),
        share(len(SYMBOL.findall(text)), n_chars), share(len(SHOUT.findall(text)), n_chars),
        share(len(STOP_PUNCT.findall(text)), n_chars), share(len(CASED.findall(text)), n_chars),
        share(n - tidy, n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(len(w) == 1 for w in words), n),
    ]


@dataclass(frozen=True)
class QdaModel:
    mean: np.ndarray        # per feature, of all training rows
    scale: np.ndarray
    centers: np.ndarray     # 2 x p, standardised
    factors: np.ndarray     # 2 x p x p: inverse Cholesky factors of the shrunk covariances
    log_det: np.ndarray     # 2
    a: float
    b: float

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        ld = []
        for k in (0, 1):
            d = (z - self.centers[k]) @ self.factors[k].T
            ld.append(-0.5 * (d * d).sum(axis=1) - self.log_det[k])
        return ld[1] - ld[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.log_density_difference(x))

    def calibrated(self, d: np.ndarray) -> np.ndarray:
        """arsinh keeps the order of far differences without letting them flatten the curve."""
        return sigmoid(self.a + self.b * np.arcsinh(d))


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``x``, the vector of statistics of the whole text."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({c: pdf[c] for c in keep} | {"x": [statistics(t) for t in pdf["_text"]]})

    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", x array<double>"
    return map_batches(docs.select(*keep, text_of().alias("_text")), run, schema)


def _sums(batches):
    """Per class: rows, sum of x, sum of x x^T (one row per task and class)."""
    n, s, q = np.zeros(2), np.zeros((2, N_FEATURES)), np.zeros((2, N_FEATURES, N_FEATURES))
    for pdf in batches:
        if not len(pdf):
            continue
        x, y = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy()
        for k in (0, 1):
            z = x[y == k]
            n[k] += len(z)
            s[k] += z.sum(axis=0)
            q[k] += z.T @ z
    for k in (0, 1):
        flat = np.concatenate(([n[k]], s[k], q[k].ravel()))
        yield pd.DataFrame({"label": k, "at": np.arange(len(flat)), "v": flat})


def fit(vectors: DataFrame, docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None,
        max_train: int = MAX_TRAIN) -> QdaModel:
    """Learn from ``labels`` (doc_id, ``label``) of the rows where ``learn`` holds; ``vectors`` as with_statistics gives."""
    learn = F.lit(True) if learn is None else learn
    sample = materialize(labelled_sample(docs, labels, label, learn, max_train), "qda_train")
    train = vectors.join(F.broadcast(sample), "doc_id").select("x", "label")
    p = N_FEATURES
    flat = np.zeros((2, 1 + p + p * p))
    for r in (map_batches(train, _sums, "label int, at int, v double").groupBy("label", "at")
              .agg(F.sum("v").alias("v")).collect()):       # 2 (1 + p + p^2) rows
        flat[r["label"], r["at"]] = r["v"]
    n, s, q = flat[:, 0], flat[:, 1:1 + p], flat[:, 1 + p:].reshape(2, p, p)
    if not n[0] or not n[1]:
        return QdaModel(np.zeros(p), np.ones(p), np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.zeros(2),
                        float(np.log((n[1] + 0.5) / (n[0] + 0.5))), 0.0)
    mean = s.sum(axis=0) / n.sum()
    var = np.diagonal(q.sum(axis=0)) / n.sum() - mean ** 2
    scale = np.sqrt(np.maximum(var, 1e-6))
    centers, cov = np.zeros((2, p)), np.zeros((2, p, p))
    for k in (0, 1):
        m = s[k] / n[k]
        centers[k] = (m - mean) / scale
        cov[k] = (q[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, log_det = np.zeros((2, p, p)), np.zeros(2)
    for k in (0, 1):
        c = (1 - TO_POOLED) * cov[k] + TO_POOLED * pooled
        c = (1 - TO_SPHERE) * c + TO_SPHERE * np.eye(p) * max(np.trace(c) / p, 1e-6)
        low = np.linalg.cholesky((c + c.T) / 2 + 1e-8 * np.eye(p))
        factors[k], log_det[k] = np.linalg.inv(low), np.log(np.diagonal(low)).sum()
    model = QdaModel(mean, scale, centers, factors, log_det, 0.0, 1.0)

    def differences(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"d": np.round(np.clip(model.log_density_difference(np.stack(pdf["x"].to_numpy())), -1000, 1000), 1),
                                    "label": pdf["label"]})

    bins = (map_batches(train, differences, "d double, label int").groupBy("d")
            .agg(F.sum("label").alias("y1"), F.sum(1 - F.col("label")).alias("y0")).collect())
    x = np.arcsinh(np.array([r["d"] for r in bins]))
    a, b = fit_logistic(x, np.array([float(r["y1"]) for r in bins]), np.array([float(r["y0"]) for r in bins]))
    return QdaModel(mean, scale, centers, factors, log_det, a, b)


def score(vectors: DataFrame, model: QdaModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and score, predicted, difference (Mahalanobis log-density difference)."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches):
        m = shared.value
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, N_FEATURES))
            d = m.log_density_difference(x)
            p = m.calibrated(d)
            yield pd.DataFrame({c: pdf[c] for c in keep} | {"score": p, "predicted": (p >= 0.5).astype("int32"),
                                                            "difference": d})

    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", score double, predicted int, difference double"
    return map_batches(vectors.select(*keep, "x"), run, schema)
