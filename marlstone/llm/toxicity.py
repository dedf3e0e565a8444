"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades run from 0 (clean) to 3. Labels say toxic or not, so grades
1 to 3 come from how densely a toxic document uses the words that set toxic
documents apart (thirds of the densities of the sample). One weight vector is
shared by all thresholds: P(grade > k) = sigmoid(w.x - t_k), with t_1 <= t_2
<= t_3 kept in order by learning the gaps on a log scale. The expected
severity is the sum of those probabilities.

Learns from at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is
not 0, the first by a hash, in the shares of toxic and clean ones that the
labels have; scores every document. A feature of fewer than ``support`` of
these documents has no weight: too few have it to tell by it. Defined cases: a
null or empty text has no features and gets the thresholds alone; without
labelled rows of both kinds every document is clean; a null doc_id is scored
like any; rows that share a doc_id are scored each by its own text, and one of
them teaches; a probability of just 1/2 is toxic; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.features import Sparse, dots, fold, labelled, mapped, stem_features
from marlstone.llm.tables import table

BITS = 18
ROWS = 8000
FOLDS = 5
GRADES = 3
SUPPORT = 8


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Ordinal:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self.used = weights != 0

    def above(self, found: list[Sparse]) -> np.ndarray:
        """P(grade > k), one column for each k."""
        z, _ = dots(found, self.weights, lambda c: np.log1p(c))
        return _sigmoid(z[:, None] - self.thresholds[None, :])

    def __call__(self, found: list[Sparse]) -> list[np.ndarray]:
        p = self.above(found)
        return [p.sum(axis=1), p[:, 0], (p >= 0.5).sum(axis=1).astype(float)]


def log_odds(x: list[Sparse], y: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's log odds to be in a toxic document, and the number of documents with it."""
    p, q = np.zeros(dims), np.zeros(dims)
    for (idx, _), label in zip(x, y, strict=True):
        (p if label else q)[idx] += 1
    n, m = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    return np.log((p + 0.5) / (n + 1)) - np.log((q + 0.5) / (m + 1)), p + q


def grades_of(x: list[Sparse], y: np.ndarray, dims: int, support: int = SUPPORT) -> np.ndarray:
    """Grades from 0 to 3: thirds of toxic documents by their density of telling words."""
    odds, seen = log_odds(x, y, dims)
    telling = (odds > np.log(4)) & (seen >= support)
    density = np.array([(c * telling[i]).sum() / max(1, c.sum()) for i, c in x])
    out = np.zeros(len(y), dtype=np.int64)
    own = density[y > 0]
    cuts = np.quantile(own, [1 / 3, 2 / 3]) if len(own) else np.zeros(2)
    out[y > 0] = 1 + (own > cuts[0]).astype(int) + (own > cuts[1]).astype(int)
    return out


def fit(x: list[Sparse], y: np.ndarray, dims: int, support: int = SUPPORT, rounds: int = 300, rate: float = 0.1, l2: float = 2e-4) -> Ordinal:
    if len(set(y.tolist())) < 2:
        return Ordinal(np.zeros(dims), np.full(GRADES, 30.0))
    odds, seen = log_odds(x, y, dims)
    keep = np.flatnonzero((seen >= support) & (np.abs(odds) > 0.7))
    place = np.full(dims, -1)
    place[keep] = np.arange(len(keep))
    grade = grades_of(x, y, dims, support)
    rows, cols, vals = [], [], []
    for r, (idx, c) in enumerate(x):
        at = place[idx]
        ok = at >= 0
        rows.append(np.full(ok.sum(), r))
        cols.append(at[ok])
        vals.append(np.log1p(c[ok]))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    # w and (t_1, log gaps): Adam on the mean negative log-likelihood
    w, t = np.zeros(len(keep)), np.array([1.0, 0.0, 0.0])
    state = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(t), np.zeros_like(t))]
    for step in range(1, rounds + 1):
        theta = np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:]))))
        z = np.bincount(rows, weights=vals * w[cols], minlength=len(y))
        cut = np.concatenate((np.full((len(y), 1), 1.0), _sigmoid(z[:, None] - theta[None, :]), np.zeros((len(y), 1))), axis=1)
        slope = cut * (1 - cut)
        up, down = np.take_along_axis(cut, grade[:, None], 1)[:, 0], np.take_along_axis(cut, grade[:, None] + 1, 1)[:, 0]
        sup, sdown = np.take_along_axis(slope, grade[:, None], 1)[:, 0], np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0]
        p = np.maximum(up - down, 1e-9)
        dz = -(sup - sdown) / p / len(y)
        gt = np.zeros(GRADES)
        for k in range(GRADES):
            gt[k] = ((grade == k + 1) * sup / p - (grade == k) * sdown / p).sum() / len(y)
        gaps = np.exp(t[1:])
        grads = (np.bincount(cols, weights=vals * dz[rows], minlength=len(w)) + l2 * w, np.array([gt.sum(), gt[1:].sum() * gaps[0], gt[2:].sum() * gaps[1]]))
        for v, g, (m1, m2) in zip((w, t), grads, state, strict=True):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(dims)
    weights[keep] = w
    return Ordinal(weights, np.concatenate(([t[0]], t[0] + np.cumsum(np.exp(t[1:])))))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS, support: int = SUPPORT) -> Ordinal:
    x, y, _ = labelled(docs, labels, "toxic", rows, stem_features, bits, fold("doc_id", FOLDS) != 0)
    return fit(x, y, 1 << bits, support)


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS, support: int = SUPPORT) -> DataFrame:
    """doc_id, held_out, expected_severity (0 to 3), p_toxic, grade and toxic of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, bits, support))
    out = mapped(
        docs, lambda found: sent.value(found), lambda texts, b: stem_features(texts, b, sent.value.used), bits, ["expected_severity", "p_toxic", "grade"],
    )
    return out.select(
        "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "expected_severity", "p_toxic",
        F.col("grade").cast("int").alias("grade"), (F.col("p_toxic") >= 0.5).alias("toxic"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_toxicity": op5}
