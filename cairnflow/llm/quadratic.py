"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .doc_stats import FEATURES, labelled_sample, with_statistics

#: Labelled documents that the classes are fitted on, at most.
SAMPLE_ROWS = 20000
#: Weight of the pooled covariance, then of an even diagonal, in each class covariance.
POOLED, EVEN = 0.1, 0.05
SCORE_CUT = 0.3
_SHARES = np.array([name.endswith("_share") and name != "distinct_share" for name in FEATURES])


def transformed(x: np.ndarray) -> np.ndarray:
    """Shares as logs, which spread what is near zero; the rest as they are."""
    return np.where(_SHARES, np.log(np.maximum(x, 0) + 1e-3), x)


@dataclass
class Quadratic:
    """Two Gaussian classes: means, inverse Cholesky factors and log-determinants, and the link from their difference to a probability."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    roots: np.ndarray  # inverse lower Cholesky factors, kept so that scoring is a product and a sum
    logdets: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (transformed(x) - self.center) / self.scale
        logs = [-0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) - 0.5 * d for m, r, d in zip(self.means, self.roots, self.logdets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def shrunk(covariance: np.ndarray, pooled: np.ndarray, *, pool: float = POOLED, even: float = EVEN) -> np.ndarray:
    mixed = (1 - pool) * covariance + pool * pooled
    return (1 - even) * mixed + even * max(float(np.trace(mixed)) / len(mixed), 1e-6) * np.eye(len(mixed))


def _link(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit on one variable, by Newton steps on smoothed labels."""
    d = np.clip(d, -60, 60)
    target = np.where(y == 1, 1 - 1 / (2 + y.sum()), 1 / (2 + (1 - y).sum()))
    w = np.array([0.1, 0.0])
    basis = np.stack([d, np.ones_like(d)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-basis @ w))
        step = np.linalg.solve(basis.T @ (basis * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2), basis.T @ (target - p) - 1e-4 * w)
        w = w + np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Quadratic:
    """Fit both classes; with a class of under 2 rows its moments are those of all rows (of none: the origin)."""
    width = len(FEATURES)
    t = transformed(x)
    center, scale = (t.mean(axis=0), np.maximum(t.std(axis=0), 1e-6)) if len(t) else (np.zeros(width), np.ones(width))
    z = (t - center) / scale
    parts = [z[y == k] if (y == k).sum() > 1 else z for k in (0, 1)]
    means = np.array([p.mean(axis=0) if len(p) else np.zeros(width) for p in parts])
    each = [np.cov(p.T, bias=True) if len(p) > 1 else np.eye(width) for p in parts]
    sizes = np.array([max(1, len(p)) for p in parts], float)
    pooled = (each[0] * sizes[0] + each[1] * sizes[1]) / sizes.sum()
    factors = [np.linalg.cholesky(shrunk(c, pooled)) for c in each]
    roots = np.array([np.linalg.inv(f) for f in factors])
    model = Quadratic(center, scale, means, roots, np.array([2 * np.log(np.diag(f)).sum() for f in factors]), 1.0, 0.0)
    if len(y) and 0 < y.mean() < 1:
        model.slope, model.offset = _link(model.difference(x), y)
    elif len(y):
        model.offset = 2.0 if y[0] else -2.0
    return model


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def with_quality(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only labels of rows that are not held out teach; a score is made from the text alone.
    Null and empty texts have the statistics of an empty text, and so a score; a null id is
    held out of learning, and its held_out is null. Repeated rows get equal scores.
    """
    model = fit(*labelled_sample(docs, labels, rows=rows, learn=lambda c: _fold(c) != 0))
    scored = with_statistics(docs, lambda _, shares: [model.score(shares)], keep=["doc_id"], extra="score double")
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= SCORE_CUT).cast("int").alias("predicted"))


def op5_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
