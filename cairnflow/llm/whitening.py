"""Embedding whitening: covariances by polarisation of exact sums of squares, then an eigendecomposition.

Vectors become whole numbers. One pass adds up the square of every centred dimension and
of the sum of every pair of dimensions, without rounding; a covariance is half of what the
variance of the pair's sum exceeds the two variances by. The driver holds numbers of the
dimensions and pairs of dimensions, as the decomposition does, and none of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Whole-number steps of a unit, and components that are returned.
SCALE, COMPONENTS = 256, 4
#: Least part of the trace that counts as variance; below it is rounding.
LEAST = 1e-12
#: Sums of any size cross Spark as limbs of 48 bits, which long sums can't overflow.
_LIMBS, _BITS = 4, 48
_LIMB_NAMES = [f"l{k}" for k in range(_LIMBS)]


def _limbs(values: list[int]) -> list[pa.Array]:
    low = [pa.array([(v >> _BITS * k) & ((1 << _BITS) - 1) for v in values], pa.int64()) for k in range(_LIMBS - 1)]
    return [*low, pa.array([v >> _BITS * (_LIMBS - 1) for v in values], pa.int64())]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as int64 if what is computed stays under the bound of a long, else as Python's integers."""
    return x if bound < 1 << 62 else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _totals(rows: DataFrame, width: int, of_batch: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows of the whole numbers that ``of_batch`` gives for a batch; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of_batch(_matrix(batch.column(0), width)).astype(object)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *_limbs(total.tolist())], names=["k", *_LIMB_NAMES])

    parts = rows.select("x").mapInArrow(run, "k int, " + ", ".join(f"{c} long" for c in _LIMB_NAMES))
    found = parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in _LIMB_NAMES)).toArrow().sort_by("k")
    return [sum(v << _BITS * k for k, v in enumerate(each)) for each in zip(*(found[c].to_pylist() for c in _LIMB_NAMES), strict=True)]


def whole(vector: str, scale: int = SCALE):
    """floor(scale * c) of every entry, null where the vector or an entry is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


@dataclass
class Whitening:
    """What was fitted: n vectors with these sums, the covariance, and the leading components with their eigenvalues."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    components: np.ndarray  # (components, dimensions)
    values: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance) if len(self.values) else self.values

    def _centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the whole part of the mean, exact as Python's integers where a long might not hold it, and what is left of n times the mean."""
        low = [s // self.n for s in self.sums]
        fits = max([_largest(x), *map(abs, low)], default=0) < 1 << 61
        y = x - np.array(low, np.int64) if fits else x.astype(object) - np.array(low, object)
        return y, np.array([s - self.n * m for s, m in zip(self.sums, low, strict=True)], object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): the centred vectors on each component, over its deviation."""
        y, rest = self._centred(x)
        return (y.astype(float) - (rest / self.n).astype(float)) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; none where a long can't hold it."""
        y, rest = self._centred(x)
        y = _exact(y, len(self.sums) * (self.n * (_largest(y) + 1)) ** 2)
        found = ((y * self.n - rest.astype(y.dtype)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in map(int, found)]


def _squares(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums of squares of the dimensions' pair sums less ``low``, a dimension with itself as it is: first (0, 0), (0, 1) and so on."""
    y = x - low if _largest(x) < 1 << 61 and _largest(low) < 1 << 61 else x.astype(object) - low
    y = _exact(y, len(y) * (2 * _largest(y)) ** 2)
    out = []
    for i in range(y.shape[1]):
        pair = y[:, i:] + y[:, i : i + 1]
        pair[:, 0] = y[:, i]
        out.append((pair * pair).sum(axis=0))
    return np.concatenate(out)


def fit(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """A whitening fitted to the distinct vectors x of ``vectors``, which are as long as most of them are (the longest if as many are)."""
    distinct = cut(vectors.select("x").distinct(), "whitening-vectors")  # equal vectors are one before the shuffle
    sizes = distinct.groupBy(F.size("x").alias("width")).count().filter("width > 0").orderBy(F.col("count").desc(), F.col("width").desc()).first()
    if not sizes:
        return None
    width, n = sizes
    rows = distinct.filter(F.size("x") == width)
    sums = _totals(rows, width, lambda x: _exact(x, len(x) * _largest(x)).sum(axis=0))
    low = [s // n for s in sums]
    squares = _totals(rows, width, lambda x: _squares(x, np.array(low, np.int64)))
    rest = np.array([s - n * m for s, m in zip(sums, low, strict=True)], object)
    upper = np.triu_indices(width)
    spread = np.empty((width, width), object)  # n squared times the variances of dimensions and of pair sums
    own = upper[0] == upper[1]
    spread[upper] = n * np.array(squares, object) - np.where(own, rest[upper[0]], rest[upper[0]] + rest[upper[1]]) ** 2
    of = np.diag(spread)
    covariance = np.zeros((width, width))
    polar = [v if i == j else (v - of[i] - of[j]) // 2 for i, j, v in zip(*upper, spread[upper], strict=True)]
    covariance[upper] = [v / (n * n) for v in polar]  # one rounding, of exact numbers
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, axes = np.linalg.eigh(covariance)
    lead = [k for k in reversed(range(width)) if values[k] > LEAST * max(np.trace(covariance), 0)][:components]
    model = Whitening(n, sums, covariance, np.array([axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k]) for k in lead]).reshape(-1, width), values[lead])
    model.identity_error = _identity_error(model, rows)
    return model


def _identity_error(model: Whitening, rows: DataFrame) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured on them."""
    k, width = model.components.shape
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column(0), width))
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    found = rows.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")["v"].to_numpy()
    mean, products = found[:k] / model.n, found[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(id, x, whitened, deviation) of every sound row, and the whitening that was fitted.

    Rows whose vector is null or holds a null or non-finite entry are dropped, as are those
    of another length than most distinct vectors have (empty ones never count). Repeated rows
    and null ids stay. Components of no variance are left out, so ``whitened`` is shorter or
    empty where the vectors span fewer; without rows there is no whitening. Entries beyond a
    long are its ends. A deviation that a long can't hold is null. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), whole(vector_col, scale).alias("x")).filter("x IS NOT NULL")
    model = fit(rows, components=components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, x array<long>, whitened array<double>, deviation long"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema), None
    k, width = model.components.shape
    sent = replace(model, covariance=np.zeros((0, 0)))  # tasks need the components alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(sent.whitened(x).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sent.deviations(x), pa.int64())], names=["id", "x", "whitened", "deviation"])

    return rows.filter(F.size("x") == width).mapInArrow(run, schema), model


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*map(F.lit, model.explained.tolist())) if model and len(model.values) else F.array(F.lit(0.0))
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "k").alias("explained"), F.lit(error).alias("identity_error"))
