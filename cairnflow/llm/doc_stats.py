"""Statistics of whole documents that quality rules and classifiers read."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, text_bytes

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "longest_word", "symbol_share", "upper_share", "digit_share", "stop_share", "shout_share", "bar_share",
    "other_share", "distinct_share", "top_share", "repeat_share", "dup_line_share", "line_words", "entropy",
]


def _set(chars: bytes) -> np.ndarray:
    own = np.zeros(256, bool)
    own[list(chars)] = True
    return own


_SPACE, _SYMBOL = _set(b" \t\n\x0b\x0c\r"), _set(SYMBOLS)
_UPPER, _LOWER, _DIGIT, _STOP, _SHOUT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789"), _set(b".,;:?"), _set(b"!")
_LEAD = np.arange(256) & 0xC0 != 0x80


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int, int]:
    """(words in windows found twice or more, distinct words, occurrences of the most frequent one)."""
    ids: dict[bytes, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    top = int(np.bincount(order).max(initial=0)) if len(order) else 0
    n = len(order) - width + 1
    if n < 2 or len(ids) == len(order):
        return 0, len(ids), top
    key = order[:n]
    for k in range(1, width):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + order[k : k + n]
    _, back, found = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(found[back] > 1)
    own = np.zeros(len(order), bool)
    for k in range(width):
        own[hit + k] = True
    return int(own.sum()), len(ids), top


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text in UTF-8."""
    words = data.split()
    n = len(words)
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(bins[_LEAD].sum() - bins[_SPACE].sum())
    symbols = int(bins[_SYMBOL].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct, top = repeated_words(words)
    size = max(1, chars)
    share = lambda own: float(bins[own].sum()) / size
    p = bins[(bins > 0) & ~_SPACE] / max(1, bins[~_SPACE].sum())
    letters = max(1, int(bins[_UPPER].sum() + bins[_LOWER].sum()))
    features = [
        float(np.log1p(n)), chars / max(1, n), float(np.log1p(max(map(len, words), default=0))), symbols / size, float(bins[_UPPER].sum()) / letters, share(_DIGIT), share(_STOP), share(_SHOUT), float(bins[124]) / size,
        float(bins[128:][_LEAD[128:]].sum()) / size, distinct / max(1.0, n) ** 0.75, top / max(1, n), repeat / max(1, n), dup / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))), float(-(p * np.log2(p)).sum()),
    ]
    return [n, chars, symbols, dup, repeat], features


def with_statistics(docs: DataFrame, score=None, *, keep: list[str], text_col: str = "text", extra: str = "", features: bool = False) -> DataFrame:
    """The columns ``keep`` with COUNTS, the features if asked for, and what ``score(counts, features)`` adds.

    ``score`` takes arrays of a batch and returns a list of arrays, described by the schema ``extra``.
    """
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for k in keep for f in docs.schema if f.name == k]
    schema = ", ".join([*kept, *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES if features), *([extra] if extra else [])])
    names = [*keep, *COUNTS, *(FEATURES if features else []), *(x.split()[0] for x in extra.split(",") if x)]

    at = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType.typeName() == "string" else None  # a text that is kept isn't sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(len(keep))] if at is None else [statistics((x.as_py() or "").encode()) for x in batch.column(at)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            shares = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            columns = [*batch.columns[: len(keep)], *(pa.array(c) for c in counts.T)]
            columns += [pa.array(c) for c in shares.T] if features else []
            columns += [pa.array(c) for c in score(counts, shares)] if score else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*keep, *([text_bytes(text_col)] if at is None else [])).mapInArrow(run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", learn=None) -> DataFrame:
    """(label, *FEATURES): a row for each labelled id of ``docs``, all of them; texts are not shuffled.

    A document's label is 1 or 0; null labels and ids are no labels, an id with several
    labels counts once with the least, and one with several texts by that of the least
    statistics.
    """
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    if learn is not None:
        own = own.filter(learn(F.col("label_id")))
    own = own.groupBy("label_id").agg(F.min("label").alias("label"))
    found = with_statistics(docs.select("doc_id", "text"), keep=["doc_id"], features=True).join(own, F.col("doc_id") == F.col("label_id"))
    return found.groupBy("label_id").agg(F.min(F.struct("label", *FEATURES)).alias("r")).select("label_id", "r.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int, label_col: str = "quality", learn=None) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of at most ``rows`` labelled documents, those with the least hash of their id.

    The bound keeps what the driver holds to a few MB. A document's label is 1 or 0; null
    labels and ids are no labels, an id with several labels counts once with the least, and one
    with several texts by that of the least statistics.
    """
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    if learn is not None:
        own = own.filter(learn(F.col("label_id")))
    own = own.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))
    found = with_statistics(picked, keep=["label_id", "label"], features=True).groupBy("label_id").agg(F.min(F.struct("label", *FEATURES)).alias("r")).select("r.*").toPandas()
    found = found.sort_values(["label", *FEATURES], kind="stable")
    return found[FEATURES].to_numpy(float), found["label"].to_numpy(int)


def in_blocks(rows: DataFrame, name: str, change=None, kind: type = np.float64) -> DataFrame:
    """(x, y) of :func:`labelled_rows`, written: FEATURES of some thousand rows as bytes of ``kind``, after ``change`` if given, and their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.float64)
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
            if len(y):
                x = x if change is None else change(x)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    return cut(rows.select("label", *FEATURES).mapInArrow(run, "x binary, y binary"), name)


def summed(blocks: DataFrame | RDD, measure, kind: type = np.float64) -> np.ndarray | None:
    """Sum of the arrays ``measure(x, y)`` of all :func:`in_blocks`, or of their :func:`block_rows`; None without any. A task sums its own, and the driver gets one array a task.

    A sum is a plain job: a loop of hundreds leaves no plans and metrics of queries with the driver.
    """

    def run(rows: Iterator[Row]) -> Iterator[bytes]:
        total = None
        for x, y in rows:
            own = measure(np.frombuffer(x, kind).reshape(-1, len(FEATURES)), np.frombuffer(y, np.uint8).astype(np.int64))
            total = own if total is None else total + own
        if total is not None:
            yield pickle.dumps(total)

    found = (blocks if isinstance(blocks, RDD) else block_rows(blocks)).mapPartitions(run).collect()
    return sum(pickle.loads(x) for x in found) if found else None


def block_rows(blocks: DataFrame, tasks: int | None = None) -> RDD:
    """The rows of :func:`in_blocks` for many sums, in one task a core at most (or ``tasks``, which suits few rows)."""
    return blocks.rdd.coalesce(min(tasks or 1 << 30, blocks.sparkSession.sparkContext.defaultParallelism))
