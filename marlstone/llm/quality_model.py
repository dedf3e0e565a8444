"""Quality classifier: naive Bayes support vectors.

N-gram indicators of a text are scaled by the log-count ratios of the two
classes, and a linear hinge-loss model is fitted on the scaled, length-normed
indicators by dual coordinate descent. The weights are drawn towards their
mean magnitude as naive Bayes would have it (``beta``), and a logistic curve
fitted on learned-from documents that were set aside gives scores from 0 to 1.

Learns from at most ``rows`` labelled documents, the first by a hash; scores
every document. Defined cases: a null or empty text has no features and gets
the model's bias; documents without a label are scored like all; a null
doc_id is scored too; without labelled rows of both classes, every score is
the share of the label; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.features import Sparse, dots, fold, labelled, mapped, shape_features
from marlstone.llm.tables import table

BITS = 18
ROWS = 6000
FOLDS = 5


def log_count_ratios(x: list[Sparse], y: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(dims, alpha), np.full(dims, alpha)
    for (idx, _), label in zip(x, y, strict=True):
        (p if label else q)[idx] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float, epochs: int, seed: int = 7) -> np.ndarray:
    """Weights (the bias last) of the hinge-loss model, one dual variable at a time."""
    w, alpha = np.zeros(dims + 1), np.zeros(len(x))
    diag = np.array([float(v @ v) + 1.0 for _, v in x])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 1.0, max(1.0, (y > 0).sum() / max(1, (y == 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            idx, v = x[i]
            g = sign[i] * (w[idx] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), c * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[idx] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic_curve(m: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """(a, b) of sigmoid(a * m + b), by damped Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, s = p - t, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(r * m).sum() + 1e-3 * a, r.sum()]))
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return float(a), float(b)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margins(self, found: list[Sparse]) -> np.ndarray:
        sums, size = dots(found, self.weights, lambda c: np.ones(len(c)))
        return sums / np.sqrt(np.maximum(size, 1)) + self.bias

    def __call__(self, found: list[Sparse]) -> list[np.ndarray]:
        return [1 / (1 + np.exp(-np.clip(self.a * self.margins(found) + self.b, -30, 30)))]


def fit(x: list[Sparse], y: np.ndarray, ids: np.ndarray, dims: int, c: float = 1.0, epochs: int = 8, beta: float = 0.5) -> Model:
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(dims, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    aside = ids % 4 == 3
    if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside = np.zeros(len(y), dtype=bool)
    r = log_count_ratios([v for v, a in zip(x, aside, strict=True) if not a], y[~aside], dims)
    scaled = [(i, r[i] / np.sqrt(max(1, len(i)))) for i, _ in x]
    w = dual_descent([v for v, a in zip(scaled, aside, strict=True) if not a], y[~aside], dims, c, epochs)
    mean = np.abs(w[:-1][w[:-1] != 0]).mean() if (w[:-1] != 0).any() else 0.0
    weights = ((1 - beta) * mean + beta * w[:-1]) * r
    model = Model(weights.astype(np.float64), float(w[-1]), 1.0, 0.0)
    held = aside if aside.any() else np.ones(len(y), dtype=bool)
    m = model.margins([v for v, h in zip(x, held, strict=True) if h])
    model.a, model.b = logistic_curve(m, y[held])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, bits: int = BITS, folds: int = FOLDS) -> Model:
    x, y, ids = labelled(docs, labels, label, rows, shape_features, bits, fold("doc_id", folds) != 0)
    return fit(x, y, ids, 1 << bits)


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows=rows, bits=bits))
    out = mapped(docs, lambda found: sent.value(found), shape_features, bits, ["score"])
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_quality_classifier": op6}
