"""An inverted-file index over vectors: cells around centroids, searched by some cells or exactly by bounds.

A row belongs to the centroid of the smallest angle. No row of a cell is nearer to a query
than the query's angle to the centroid less the cell's largest angle, which tells the cells
that an exact search can leave out. Queries meet rows in groups of one cell, both sides
dealt so that a group has about GROUP of each, however large a cell or a query set is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that centroids are fitted on, at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 10
#: Rows, and queries, of a group that a task scores at once, about.
GROUP = 4096
#: What angles may be off by.
SLACK = 1e-6


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; missing elements are zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        own = [0.0 if x is None else x for x in (r or [])[:width]]
        out[i, : len(own)] = own
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def fit_centroids(vectors: DataFrame, cells: int | None = None, *, vector_col: str = "embedding", sample: int = SAMPLE, seed: int = 3) -> np.ndarray:
    """Unit centroids, the square root of the rows by default, by spherical k-means on at most ``sample`` rows of the least hash."""
    rows = vectors.filter(F.size(vector_col) > 0).select(F.col(vector_col).alias("v"))
    n = rows.count()
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    some = rows.filter(place < min(1 << 30, (2 * sample << 30) // max(1, n))).orderBy(F.xxhash64("v")).limit(sample).toArrow().combine_chunks()
    if not some.num_rows:
        return np.zeros((1, 1))
    x = unit(matrix(some["v"], max(len(v) for v in some["v"].to_pylist())))
    x = np.unique(x, axis=0)
    cells = min(len(x), cells or max(1, round(n**0.5)))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[low : low + 4096] @ centres.T).argmax(axis=1) for low in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-12, unit(sums), centres)
    return centres


def placed(rows: DataFrame, centres: np.ndarray, *, vector_col: str = "embedding") -> DataFrame:
    """Rows with their ``cell`` and the ``angle`` to its centroid; written with ``partitionBy("cell")`` a search reads its own cells alone."""
    width = centres.shape[1]
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = rows_names.index(vector_col)
        for batch in batches:
            near = unit(matrix(batch.column(at), width)) @ centres.T
            cell = near.argmax(axis=1) if len(near) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(near)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle)], names=[*rows_names, "cell", "angle"])

    rows_names = rows.columns
    return rows.mapInArrow(run, schema)


def candidates(queries: DataFrame, index: DataFrame, centres: np.ndarray, *, by: str | None = None) -> DataFrame:
    """(query_id, by, embedding, cell, bound, nearness) of each query and each cell that has rows under its ``by``: the best cosine that a row may have, and the cell's rank by angle."""
    key = "_by" if by is None else by
    own = queries if by else queries.withColumn(key, F.lit(0))
    rows = index if by else index.withColumn(key, F.lit(0))
    width = centres.shape[1]
    source = own.select("query_id", key, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.arccos(np.clip(unit(matrix(batch.column(2), width)) @ centres.T, -1, 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1) * len(centres), pa.int32()), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", key, "embedding", "angles"])

    asked = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("angles", T.ArrayType(T.DoubleType()))]))
    held = rows.groupBy(key, "cell").agg(F.max("angle").alias("radius"))
    both = asked.join(held, key) if by else asked.join(F.broadcast(held.drop(key)))  # without a key there is a row for each centroid
    angle = F.get("angles", "cell")
    order = Window.partitionBy("query_id").orderBy(angle, "cell")
    return both.withColumn("bound", F.cos(F.greatest(F.lit(0.0), angle - F.col("radius") - SLACK))).withColumn("nearness", F.row_number().over(order)).select("query_id", F.col(key).alias("_by"), "embedding", "cell", "bound", "nearness")


def scored(targets: DataFrame, index: DataFrame, k: int, *, id_col: str, by: str | None = None, digits: int = 6, width: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each group for the queries (query_id, _by, embedding, cell) that are sent to its cell."""
    rows = index.withColumn("_by", F.lit(0) if by is None else F.col(by)).select(F.col(id_col).alias("id"), "_by", "cell", F.col("embedding").alias("vector"))
    wanted = targets.groupBy("_by", "cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    sizes = rows.groupBy("_by", "cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares")).join(wanted, ["_by", "cell"])
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = targets.join(sizes, ["_by", "cell"]).select("query_id", "_by", "cell", "embedding", number("query_id", "parts").alias("part"), each("shares").alias("share"))
    right = rows.join(sizes, ["_by", "cell"]).select("id", "_by", "cell", "vector", number("id", "shares").alias("share"), each("parts").alias("part"))
    keys = ["_by", "cell", "share", "part"]
    right = right.select("id", "vector", *(F.col(c).alias(f"{c}_") for c in keys))  # both sides come from one table
    kinds = [f.dataType.simpleString() for f in (targets.schema["query_id"], index.schema[id_col])]

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        x, q = (unit(matrix(t[c].combine_chunks(), width)) for t, c in ((there, "vector"), (asked, "embedding")))
        scores = np.round(q @ x.T, digits)
        some = min(k, len(x))
        if some < len(x):  # and all that tie with the last, which go by id afterwards
            least = np.partition(scores, len(x) - some, axis=1)[:, len(x) - some]
            at, row = np.nonzero(scores >= least[:, None]) if len(q) else (np.zeros(0, int),) * 2
        else:
            at, row = np.nonzero(np.ones_like(scores, bool))
        return pa.table({"query_id": asked["query_id"].take(pa.array(at)), "id": there["id"].take(pa.array(row)), "score": pa.array(scores[at, row])})

    met = left.groupBy(*keys).cogroup(right.groupBy(*(f"{c}_" for c in keys))).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return met.withColumnRenamed("id", id_col)


def _first(found: DataFrame, k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def index_topk(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, *, probes: int, exact: bool = False, id_col: str = "doc_id", by: str | None = None, digits: int = 6) -> DataFrame:
    """The k rows most alike to each query (query_id, embedding) in its ``probes`` nearest cells, ties by id.

    ``exact`` goes on to every cell whose bound reaches the k-th score that was found, so the
    result is that of a search over all rows.
    """
    sent = candidates(queries, index, centres, by=by)
    how = {"id_col": id_col, "by": by, "digits": digits, "width": centres.shape[1]}
    found = _first(scored(sent.filter(F.col("nearness") <= probes), index, k, **how), k, id_col)
    if not exact:
        return found
    least = found.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    open_cells = sent.filter(F.col("nearness") > probes).join(least, "query_id", "left").filter(F.col("_n").isNull() | (F.col("_n") < k) | (F.col("bound") + 2 * 10.0**-digits >= F.col("_least")))
    rest = scored(open_cells.select("query_id", "_by", "embedding", "cell"), index, k, **how)
    return _first(found.drop("rank").unionByName(rest), k, id_col)


def tuned_probes(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, *, recall: float = 0.93, sample: int = 200, id_col: str = "doc_id") -> int:
    """Cells that queries must ask for this share of their k best rows, measured on at most ``sample`` of them by an exact search."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    best = index_topk(some, index, centres, k, probes=1, exact=True, id_col=id_col)
    where = best.join(index.select(id_col, "cell"), id_col).join(candidates(some, index, centres).select("query_id", "cell", "nearness"), ["query_id", "cell"])
    counts = {r.nearness: r["count"] for r in where.groupBy("nearness").count().collect()}
    total, seen = sum(counts.values()), 0
    for n in sorted(counts):
        seen += counts[n]
        if seen >= recall * total:
            return n
    return len(centres)


def best_within(queries: DataFrame, index: DataFrame, centres: np.ndarray, least: float, *, by: str, id_col: str, digits: int = 9) -> DataFrame:
    """(query_id, id, score): the row most alike to each query under its ``by`` if it reaches ``least``; cells that can't are never looked at."""
    sent = candidates(queries, index, centres, by=by).filter(F.col("bound") + SLACK >= least)
    found = scored(sent, index, 1, id_col=id_col, by=by, digits=digits, width=centres.shape[1])
    return _first(found.filter(F.col("score") >= least), 1, id_col).drop("rank")


def pairs_scanned(queries: DataFrame, index: DataFrame, centres: np.ndarray, *, keep: Column, by: str | None = None) -> DataFrame:
    """One row (scanned, all): pairs of a query and a row that the cells of ``keep``, an expression of the candidates, make."""
    rows = index.withColumn("_by", F.lit(0) if by is None else F.col(by)).groupBy("_by", "cell").agg(F.count("*").alias("n"))
    sent = candidates(queries, index, centres, by=by).join(rows, ["_by", "cell"])
    return sent.agg(F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("scanned"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
