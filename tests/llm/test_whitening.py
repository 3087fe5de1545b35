"""Whitening against exact fractions and numpy's own covariance."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from cairnflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors):
    """Distinct whole vectors, their sums, and the covariance by fractions."""
    xs = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    d = [[Fraction(c) - Fraction(s, n) for c, s in zip(x, sums, strict=True)] for x in xs]
    return xs, sums, [[sum(r[i] * r[j] for r in d) / n for j in range(len(sums))] for i in range(len(sums))]


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.standard_normal((200, 5)) * [1, 5, 0.1, 2, 3] + [0, 1000, -7, 0, 3]).astype(np.float32).tolist()
    vectors += vectors[:50]
    rows, model = W.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(3))
    xs, sums, wanted = exact(vectors)
    assert (model.n, model.sums) == (len(xs), sums)
    assert model.covariance.tolist() == [[float(v) for v in row] for row in wanted]
    got = {r.id: r for r in rows.collect()}
    assert len(got) == 250
    for k, v in enumerate(vectors):
        x = [math.floor(256 * c) for c in v]
        assert got[k].x == x and got[k].deviation == sum((model.n * a - s) ** 2 for a, s in zip(x, sums, strict=True))


def test_whole_table_of_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = W.op13_whitening(spark, folder).toPandas()
    raw = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(256 * np.array([v for _, v in raw], float))
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(v)
    assert len(rows) == 4 * len(raw) and set(rows.n) == {len(fit)} and rows.identity_error.max() < 1e-9 and rows.identity_error.nunique() == 1
    for k in range(1, 5):
        own = rows[rows.component == k].sort_values("vec_id")
        assert own.explained.to_numpy() == pytest.approx(values[-k] / np.trace(v), rel=1e-9)
        wanted = (x - fit.mean(axis=0)) @ axes[:, -k] / np.sqrt(values[-k])
        sign = np.sign(wanted[0] * own.whitened.iloc[0])
        assert np.abs(own.whitened.to_numpy() * sign - wanted).max() < 1e-8
    assert rows.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.5, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 1.0]), (9, []), (10, [1.0]), (None, [-0.001, 0.0])]
    found, model = W.whiten(spark.createDataFrame([(*r, [1], 2, "a", "b") for r in rows], SCHEMA + ", x array<int>, id int, whitened string, deviation string"))
    assert model.n == 4
    got = found.collect()
    assert sorted((r.id or 0, r.x) for r in got) == [(0, [-1, 0]), (1, [256, 512]), (1, [256, 512]), (2, [768, -256]), (3, [128, 64])]
    assert all(len(r.whitened) == 2 for r in got) and model.identity_error < 1e-9


@pytest.mark.parametrize("rows, n, components", [([], None, 0), ([[1.0, 2.0]] * 3, 1, 0), ([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]], 3, 1), ([[]], None, 0)])
def test_few_and_flat_vectors(spark, rows, n, components):
    found, model = W.whiten(spark.createDataFrame(list(enumerate(rows)), SCHEMA))
    assert (model and model.n) == n
    assert all(len(r.whitened) == components for r in found.collect())


def test_huge_entries_stay_exact(spark):
    vectors = [[1e30, 1.0], [2.0**54, 2.0], [-(2.0**50), 5.0], [3.0, 4.0]]
    rows, model = W.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    xs = [[(1 << 63) - 1, 256], [1 << 62, 512], [-(1 << 58), 1280], [768, 1024]]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert model.sums == sums
    spread = sum((4 * x[0] - sums[0]) * (4 * x[1] - sums[1]) for x in xs)
    assert model.covariance[0, 1] == float(Fraction(spread, 64))
    assert {r.id: r.deviation for r in rows.collect()} == dict.fromkeys(range(4))
