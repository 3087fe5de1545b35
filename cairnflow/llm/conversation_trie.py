"""Prefix trie of conversations by a splitter skeleton.

Conversations are paths of turns, sorted over shards whose splitters come from a sample. A
node whose members lie in more than one shard starts with a path that a splitter starts
with too: the trie of all splitters' paths, the skeleton, goes to every task. A shard walks
its sorted paths with one stack and finishes all other nodes; of skeleton nodes it gives
partial sums, which are added up at the end.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Conversations of a shard, at most by the sample, and sampled paths for each shard.
SHARD_CONVS, SAMPLED = 100_000, 20
#: Bytes of all sampled paths together, and so of the skeleton: longer paths are cut, which changes where shards end and nothing else.
SKELETON_BYTES = 64 << 20
#: Ids of a skeleton node's members that a row holds.
CHUNK = 2000
#: Bytes of a turn in a path: 16 of the hash of role and text, 8 of the text's size.
TURN = 24
_NONE = hashlib.sha256(b"").hexdigest()
_LEAST = -(1 << 63)


def turn_paths(conversations: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) of every conversation: its turns in order, each as hex of a hash and the text's size.

    Turns go by ``order_col``, null first, then by role and text; null role and text are
    empty; repeated rows are repeated turns. Rows without an id belong to no conversation.
    Texts stay where they are, only their hashes are shuffled; a conversation's are one row.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    sized = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.concat(F.substring(F.sha2(sized.cast("binary"), 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("o"), role.alias("r"), F.lit(0).alias("k"), turn.alias("x"), text.alias("t")).filter("conv_id IS NOT NULL")

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("o", "r", "k", "x"))).alias("s"))  # nulls come first

    found = cut(gathered(rows), "trie-turns")
    places = F.size(F.array_distinct(F.transform("s", lambda s: F.struct(s["o"], s["r"]))))
    tied = found.filter(places < F.size(F.array_distinct("s"))).select("conv_id")
    if tied.take(1):  # turns that only their texts can order
        ranked = rows.join(tied, "conv_id", "left_semi").withColumn("k", F.dense_rank().over(Window.partitionBy("conv_id", "o", "r").orderBy("t")))
        found = found.join(tied, "conv_id", "left_anti").unionByName(gathered(ranked))
    return found.select("conv_id", F.col("s.x").alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 5 in the place of its own, h = crc32(c) % 9; missing turns are left out."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = paths.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    both = paths.withColumn("base", F.expr("conv_id - conv_id % 5")).withColumn("h", h).join(heads, "base", "left")
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


class Skeleton:
    """The trie of the splitters' paths: node 0 is the root, and ``below`` tells the node that a turn leads to."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.below: dict[tuple[int, bytes], int] = {}
        self.parent, self.turn = [-1], [b""]
        for path, _ in splitters:
            at = 0
            for i in range(0, len(path), TURN):
                step = (at, path[i : i + TURN])
                if step not in self.below:
                    self.below[step] = len(self.parent)
                    self.parent.append(at)
                    self.turn.append(step[1])
                at = self.below[step]


def _common(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // TURN
    return int((np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)).argmax()) // TURN


class _Open:
    """A node whose members are still being read."""

    __slots__ = ("skeleton", "size", "low", "n", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, skeleton: int | None, size: int) -> None:
        self.skeleton, self.size, self.low = skeleton, size, None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends = None  # a hash; of a skeleton node the ids that no row has yet
        self.waiting: list[tuple] = []  # finished children, whose rows name the smallest member of this node


def walk(rows: Iterator[tuple[bytes, int]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of _SCHEMA for one shard's (path, id), which come sorted."""
    stack, before, out = [], b"", []

    def ids(node: _Open) -> None:
        out.append(("ends", node.ends[0], None, None, node.skeleton, len(node.ends), None, None, None, ",".join(map(str, node.ends))))
        node.ends = None

    def close() -> None:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if node.skeleton is not None:
            if node.ends:
                ids(node)
            out.append(("part", node.low, depth, None, node.skeleton, node.n, node.children, node.leaves, node.saved, None))
        else:
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            out.extend(("node", low, d, node.low, None, *rest) for low, d, *rest in node.waiting)
            row = (node.low, depth, node.n, node.children, leaves, saved, node.ends.hexdigest() if node.ends else _NONE)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            if above.skeleton is None:
                above.waiting.append(row)
            else:
                out.append(("node", row[0], depth, None, above.skeleton, *row[2:]))
        if above is not None:
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)

    for path, conv in rows:
        if not stack:
            stack.append(_Open(0, 0))
        same = _common(before, path)
        while len(stack) - 1 > same:
            close()
        for i in range(same * TURN, len(path), TURN):
            turn, above = path[i : i + TURN], stack[-1].skeleton
            stack.append(_Open(None if above is None else skeleton.below.get((above, turn)), int.from_bytes(turn[16:])))
        node, before = stack[-1], path
        node.n += 1
        node.low = conv if node.low is None else min(node.low, conv)
        if node.skeleton is not None:
            node.ends = node.ends or []
            node.ends.append(conv)
            if len(node.ends) >= CHUNK:
                ids(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv)
        else:
            node.ends.update(b",%d" % conv)
        if len(out) >= 1000:
            yield from out
            out.clear()
    while stack:
        close()
    yield from out


_SCHEMA = "kind string, conv_id long, depth long, parent_conv_id long, skeleton int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Bounds of the shards, by (path, id), from a sample of about SAMPLED paths a shard that is SKELETON_BYTES long at most."""
    rows = paths.count()
    wanted = shards * SAMPLED
    width = max(8, SKELETON_BYTES // (2 * wanted) // TURN) * TURN
    some = paths.filter(F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, (wanted << 30) // max(1, rows)))).orderBy(F.xxhash64(F.lit(3), "conv_id")).limit(2 * wanted)
    got = sorted((bytes(r[0]), r[1] if r[2] else _LEAST) for r in some.select(F.substring("path", 1, width), "conv_id", F.octet_length("path") <= width).collect())
    return sorted({got[len(got) * k // shards] for k in range(1, shards)}) if got else []


def _ends(chunks: DataFrame) -> dict[int, str]:
    """Hashes of the skeleton nodes' members, which come as ids of one shard after another; one row is in hand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        done = []
        for node, ids in rows:
            if node != at:
                done += [(at, found.hexdigest())] if found else []
                at, found = node, hashlib.sha256(ids.as_py().encode())
            else:
                found.update(b"," + ids.as_py().encode())
        done += [(at, found.hexdigest())] if found else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int32()), pa.array([r[1] for r in done], pa.string())], names=["skeleton", "sha"])

    with small_batches(chunks.sparkSession, 200):
        sorted_ids = chunks.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").select("skeleton", "ends_sha256")
        return dict(map(tuple, sorted_ids.mapInArrow(run, "skeleton int, sha string").collect()))


def prefix_trie(paths: DataFrame, *, shards: int | None = None) -> DataFrame:
    """A row of COLUMNS for each distinct prefix of the turns of ``paths`` (conv_id, turns), from the root down.

    Members are the conversations that start with it; without any there is no root.
    Conversations without turns end at the root. Conversations of equal turns, however many,
    are spread over shards by id; a shard's finished nodes wait only for the smallest id of
    the node above them. The hash of a node's ids is one pass over them in order by nature.
    """
    spark = paths.sparkSession
    rows = cut(paths.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path")), "trie-paths")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_CONVS))
    splitters = _splitters(rows, shards)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [bisect_right(splitters, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=["conv_id", "path", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = walk((r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), Skeleton(splitters)), []
        for row in found:
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)

    spread = rows.mapInArrow(dealt, "conv_id long, path binary, shard int").repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("path", "conv_id")
    nodes = cut(spread.select("path", "conv_id").mapInArrow(run, _SCHEMA), "trie-nodes")
    top = _skeleton_rows(nodes, Skeleton(splitters))
    names = spark.createDataFrame([(k, r[0]) for k, r in top.items()], "skeleton int, low long")  # SKELETON_BYTES bounds it
    below = nodes.filter("kind = 'node'").join(F.broadcast(names), "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low")).select(*COLUMNS)
    return below.unionByName(spark.createDataFrame(list(top.values()), below.schema))


def _skeleton_rows(nodes: DataFrame, skeleton: Skeleton) -> dict[int, tuple]:
    """Rows of COLUMNS of the skeleton's nodes: sums over the shards, then from the lowest nodes up."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter("kind = 'part'").groupBy("skeleton").agg(F.min("conv_id").alias("low"), F.first("depth").alias("depth"), *sums).collect()
    of = {r.skeleton: [r.low, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens] for r in parts}
    ends = _ends(nodes.filter("kind = 'ends'")) if of else {}
    for k in sorted(of, reverse=True):  # a node comes after the one above it
        low, _, n, children, leaves, saved = of[k]
        of[k][4] = leaves if children else 1
        of[k][5] = saved + (n - 1) * int.from_bytes(skeleton.turn[k][16:])
        if k:
            above = of[skeleton.parent[k]]
            above[3] += 1
            above[4] += of[k][4]
            above[5] += of[k][5]
    return {k: (r[0], r[1], of[skeleton.parent[k]][0] if k else None, *r[2:], ends.get(k, _NONE)) for k, r in of.items()}


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_paths(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = """
    WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role, text) AS s FROM t GROUP BY conv_id),
    crc(conv_id, j, v) AS (
        SELECT conv_id, 0, 4294967295::BIGINT FROM o
        UNION ALL
        SELECT conv_id, j + 1, xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END)
        FROM (SELECT conv_id, j, CASE WHEN j % 8 = 0 THEN xor(v, ascii(substr(conv_id::VARCHAR, j // 8 + 1, 1))::BIGINT) ELSE v END AS u FROM crc WHERE j < 8 * length(conv_id::VARCHAR))
    ),
    h AS (SELECT conv_id, xor(v, 4294967295) % 9 AS h FROM crc WHERE j = 8 * length(conv_id::VARCHAR)),
    r AS (
        SELECT o.conv_id, list_concat(coalesce(list_slice(b.s, 1, h.h), []), list_slice(o.s, h.h + 1, len(o.s))) AS seq
        FROM o JOIN h USING (conv_id) LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5
    ),
    i AS (SELECT conv_id, seq, array_to_string(list_transform(seq, lambda x: md5(strlen(x.r) || ':' || x.r || x.x)), '') AS path FROM r),
    p AS (SELECT conv_id, d, len(seq) = d AS is_end, coalesce(strlen(seq[d].x), 0) AS size, substr(path, 1, 32 * d) AS path FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM i)),
    n AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
            sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM p GROUP BY path, d
    ),
    c AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    w AS (SELECT n.path, d, (n_convs - 1) * size AS saved, (c.path IS NULL)::INT AS leaf FROM n LEFT JOIN c USING (path)),
    s AS (SELECT substr(path, 1, 32 * k) AS path, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS k FROM w) GROUP BY 1)
    SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
        s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM n JOIN s USING (path) LEFT JOIN c USING (path) LEFT JOIN n a ON n.d > 0 AND a.path = substr(n.path, 1, 32 * (n.d - 1))
"""
