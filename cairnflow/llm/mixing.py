"""Mixing sources to target weights over token blocks of fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_bytes

BLOCK_WORDS = 64
SHARD_SLOTS = 16384
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SEED = 20260
#: Parts of a source whose sizes are summed apart, so that no task orders a whole source.
PARTS = 1024
#: Sources up to which their table is broadcast to joins by source, which a hot source would bend.
BROADCAST_SOURCES = 500_000
#: Shards whose slots one task draws at once, and tasks at most; numbers of shards are too small for Spark to tell how many rows they stand for.
SHARDS_AT_ONCE = 8
MOST_TASKS = 10000
#: Slots that are drawn without replacement together; larger mixes are strata with an even part of every source.
STRATUM_SLOTS = 1 << 29


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each ``index`` in a pseudorandom permutation of ``range(size)`` named by ``key``.

    A balanced Feistel network over the next power of four, walked until the place is
    below ``size``; nothing is stored and any index can be asked for alone.
    """
    size = np.asarray(size, np.int64)
    half = ((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    key = np.asarray(key).astype(np.uint64)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, h, mask, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & mask
        for turn in range(4):
            f = (right ^ k) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn + 1)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & mask)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len(x.as_py().split()) for x in batch.column(0)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], names=["doc_id", "source", "h", "size"])


def sized(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(doc_id, source, h, size): words of every row and a hash that tells rows of one id apart."""
    own = docs.select(text_bytes(text_col), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_col, F.col("source").isNull()).alias("h"))
    return own.mapInArrow(_word_counts, "doc_id long, source string, h long, size long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(sid, source, source_size, target, blocks, slots) of each source, by code point, null last.

    Weights repeat in that order. Targets share the sum of all sizes by weight but stop at
    ``most_times`` times a source's size; what is over is shared again among the others.
    A row for each source goes through the driver: a mix is of far fewer sources than documents.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    size = np.array([r["size"] for r in rows], np.int64)
    weight = np.array(weights, float)[np.arange(len(rows)) % len(weights)]
    room, level, total = size * most_times, 0.0, int(size.sum())
    while total:
        over = weight * level >= room
        rest = float(weight[~over].sum())
        after = (total - int(room[over].sum())) / rest if rest else level
        if after <= level:
            break
        level = after
    target = np.minimum(weight * level, room.astype(float))
    blocks = -(-size // block_words)
    slots = np.minimum(np.rint(target * blocks / np.maximum(size, 1)).astype(np.int64), blocks * most_times)
    made = [(i, r.source, *map(int, row[:1]), float(row[1]), *map(int, row[2:])) for i, (r, row) in enumerate(zip(rows, zip(size, target, blocks, slots, strict=True), strict=True))]
    out = sizes.sparkSession.createDataFrame(made, "sid long, source string, source_size long, target double, blocks long, slots long")
    return F.broadcast(out) if len(made) <= BROADCAST_SOURCES else out


def _key(*parts: int) -> int:
    return zlib.crc32(" ".join(map(str, parts)).encode())


def shard_counts(slots: np.ndarray, edges: np.ndarray, low: int, high: int, seed: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, those of earlier shards) for the shards from ``low`` to ``high``.

    Shard j has ``edges[j + 1] - edges[j]`` slots. Its counts by source are a multinomial
    draw on condition that the sources' totals come out: halves of the shards draw without
    replacement from what the sources have left, down to single shards. Every draw has a
    seed of its own, so any range of shards can be told alone.
    """

    def walk(a: int, b: int, left: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, left, before
            return
        middle = (a + b) // 2
        first = np.random.default_rng([*seed, a, b]).multivariate_hypergeometric(left, int(edges[middle] - edges[a]), method="marginals")
        yield from walk(a, middle, first, before)
        yield from walk(middle, b, left - first, before + first)

    return walk(0, len(edges) - 1, slots, np.zeros_like(slots))


def mixed_slots(sources: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, place, sid, slot, epoch, block): the block at each place of each output shard.

    Each shard draws its counts by source (:func:`shard_counts`); its slots of one source
    continue those of the shards before. Slot i is place ``i % blocks`` of the source's
    permutation for epoch ``i // blocks``: all blocks once before any again. A shard's slots
    lie at permuted places.
    """
    rows = sorted(sources.filter("slots > 0").select("sid", "blocks", "slots").collect())
    sid, blocks, slots = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    strata = max(1, -(-int(slots.sum()) // STRATUM_SLOTS))
    cuts = np.array([slots * k // strata for k in range(strata + 1)])  # each source's slots of each stratum begin here
    totals = np.diff(cuts, axis=0).sum(axis=1)
    shards = max(1, -(-int(totals.max(initial=0)) // shard_slots))
    groups = -(-shards // SHARDS_AT_ONCE)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in (int(u) for frame in frames for u in frame["id"]):
            stratum, low = unit // groups, unit % groups * SHARDS_AT_ONCE
            edges = int(totals[stratum]) * np.arange(shards + 1) // shards
            for shard, n, before in shard_counts(cuts[stratum + 1] - cuts[stratum], edges, low, low + SHARDS_AT_ONCE, (seed, stratum)):
                total = int(n.sum())
                own = np.repeat(np.arange(len(sid)), n)
                slot = (cuts[stratum] + before)[own] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                epoch = slot // blocks[own]
                names, back = np.unique(np.stack([sid[own], epoch]), axis=1, return_inverse=True)
                keys = np.array([_key(seed, int(s), int(e)) for s, e in names.T], np.uint64)[back.ravel()]
                block = permuted(slot % blocks[own], blocks[own], keys)
                number = stratum * shards + shard
                place = permuted(np.arange(total), np.full(total, total), np.full(total, _key(seed, number, -1)))
                yield pd.DataFrame({"shard": number, "place": place, "sid": sid[own], "slot": slot, "epoch": epoch, "block": block})

    units = strata * groups if len(sid) else 0
    return sources.sparkSession.range(0, units, 1, max(1, min(units, MOST_TASKS))).mapInPandas(draw, "shard long, place long, sid long, slot long, epoch long, block long")


def _times(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(sid, block, times, first): how often the mix takes a block, and the first shard and place that do."""
    return mixed_slots(sources, seed=seed).groupBy("sid", "block").agg(F.count("*").alias("times"), F.min(F.struct("shard", "place")).alias("first"))


def placed(sizes: DataFrame, sources: DataFrame, *, parts: int = PARTS) -> DataFrame:
    """``sizes`` with sid and ``at``, the words before the document in its source, in an order by hash."""
    own = sizes.join(sources.select("sid", "source"), sizes.source.eqNullSafe(sources.source)).drop(sources.source)
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)))
    before = own.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("sid", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "part").orderBy("doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["sid", "part"]).withColumn("at", F.col("base") + F.col("within")).drop("base", "within", "part")


def _pieces(where: DataFrame, times: DataFrame, block_words: int) -> DataFrame:
    """A row for each piece of a document in a block that slots name: low and high in words of the document."""
    blocks = F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))
    pieces = where.filter("size > 0").withColumn("block", F.explode(blocks)).join(times.hint("merge"), ["sid", "block"], "left").fillna(0, ["times"])
    low = F.greatest(F.lit(0), F.col("block") * block_words - F.col("at"))
    high = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at"))
    return pieces.withColumn("low", low).withColumn("high", high)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard, place) of every row: the words that the mix takes of it, and the first shard and place there that hold any (else null).

    A null text has no words and null is a source of its own. Equal rows are mixed one by
    one. Ids are taken as long integers. Other columns are ignored. Reruns agree: draws depend on the seed, the sources'
    sizes and rows alone.
    """
    sizes = cut(sized(docs), "mixing-sizes")
    sources = targets(sizes, weights=weights, most_times=most_times, block_words=block_words)
    where = placed(sizes, sources)
    taken = F.sum(F.col("times") * (F.col("high") - F.col("low"))).alias("taken")
    rows = _pieces(where, _times(sources, seed), block_words).groupBy("doc_id", "h", "sid", "at", "size").agg(taken, F.min("first").alias("first"))
    facts = sources.select("sid", "source_size", "target")
    rows = rows.select("doc_id", "sid", "size", "taken", "first.shard", "first.place")
    none = F.lit(None).cast("long")
    rows = rows.unionByName(where.filter("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"), none.alias("shard"), none.alias("place")))
    return rows.join(facts, "sid").select("doc_id", "size", "source_size", "target", "taken", "shard", "place")


def _cut_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Words low to high of each span, with what is between them; spans are joined by a line break."""
    words = [m.span() for m in _WORD.finditer(data)]
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return b"\n".join(data[words[a][0] : words[b - 1][1]] for a, b in merged)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents: a row for each whole epoch that a document is in, and one with its pieces of the last, partial epoch.

    Rows of a partition come in the order of the first shard and place that take their
    document. Documents without words in the mix go, so null and empty texts do; repeated
    rows are mixed one by one. ``n_chars`` is kept true where the table has it; other
    columns pass through, whatever their names and types.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), "h"]
    same = Window.partitionBy("_id", "h").orderBy("size", "sid", "at")
    sizes = cut(sized(docs), "mixing-sizes")
    sources = targets(sizes)
    where = placed(sizes, sources)
    epochs = sources.select("sid", F.expr("slots DIV greatest(blocks, 1)").alias("epochs"))
    pieces = _pieces(where, _times(sources), BLOCK_WORDS).join(epochs, "sid")
    last = F.collect_list(F.when(F.col("times") > F.col("epochs"), F.struct("low", "high")))
    spans = pieces.groupBy("doc_id", "h", "sid", "at", "size").agg(F.first("epochs").alias("epochs"), last.alias("spans"), F.min("first").alias("first"))
    spans = spans.select(*key, "sid", "at", "size", "epochs", "spans", "first").withColumn("_n", F.row_number().over(same)).select("_id", "h", "_n", "epochs", "spans", "first")
    names = [f"_{i}" for i in range(len(docs.columns))]
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    plain = docs.select("*", F.xxhash64("text", F.col("source").isNull()).alias("_h")).toDF(*names, "h")
    plain = plain.withColumn("_id", F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(-(1 << 63))))
    rest = F.to_json(F.struct(*(n for i, n in enumerate(names) if i != text)))  # orders columns of any type
    numbered = plain.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "h").orderBy(rest)))
    joined = numbered.join(spans, ["_id", "h", "_n"]).sortWithinPartitions("first.shard", "first.place").select(*names, "epochs", "spans")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            epochs, spans = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            for i in range(batch.num_rows):
                body = batch.column(text)[i].as_py() or ""
                made = [body] * epochs[i]
                if spans[i]:
                    made.append(_cut_words(body.encode(), [(s["low"], s["high"]) for s in spans[i]]).decode())
                rows += [i] * len(made)
                texts += made
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(names)]]
            taken[text] = pa.array(texts, pa.string())
            if chars >= 0:
                taken[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(taken[chars].type)
            yield pa.RecordBatch.from_arrays(taken, names=names)

    return joined.mapInArrow(run, schema).toDF(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
