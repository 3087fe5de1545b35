"""Sharding in the order of a Hilbert curve over metadata."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 40
BITS = 6
#: A group of equal texts over this part of a shard's bytes is placed by itself.
GROUP_PART = 64


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, ``bits`` bits each).

    Skilling's transform: axes to transposed index by exchanges and Gray decoding, then the
    bits of all dimensions are interleaved.
    """
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums, each of one column over the rows before in ``order``, which must tell rows apart.

    Ranges of the order are summed apart; one row a range goes through a common window.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()), "hilbert-runs")
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    per = runs.groupBy("run").agg(*(F.sum(c).alias(f"_{c}") for c in sums.values()))
    per = per.select("run", *(zero(f"_{c}", before).alias(f"_{name}") for name, c in sums.items()))
    out = runs.select("*", *(zero(c, inside).alias(name) for name, c in sums.items())).join(F.broadcast(per), "run")
    return out.select(*rows.columns, *((F.col(name) + F.col(f"_{name}")).alias(name) for name in sums))


def _with_cell(units: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``units`` with ``name``_cell: the different values of ``rows`` in order, spread over the cells, null first."""
    values = rows.select(F.col(name).alias("v")).distinct().withColumn("none", F.col("v").isNotNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = _running(values, ["none", "v"], {"rank": "one"})
    n = ranked.count()
    cells = ranked.select("v", F.floor(F.col("rank") * (1 << BITS) / max(1, n)).cast("long").alias(f"{name}_cell"))
    return units.join(cells, units[name].eqNullSafe(cells.v)).drop("v")


def dealt_groups(groups: list[tuple[int, int]], shards: int, room: float) -> list[tuple[int, int, int, int, int]]:
    """(group, first row, rows, shard, first slot) for groups of (rows, bytes of a row): the largest first, each into the shard with most room left of ``room`` bytes.

    A group is cut, between rows, only where no shard has room for all of it.
    """
    free = [(-room, s) for s in range(shards)]
    taken, out = [0] * shards, []
    for g in sorted(range(len(groups)), key=lambda g: (-groups[g][0] * groups[g][1], g)):
        rows, size = groups[g]
        first = 0
        while first < rows:
            left, s = heapq.heappop(free)
            n = min(rows - first, max(1, int(-left // size)))
            out.append((g, first, n, s, taken[s]))
            taken[s] += n
            heapq.heappush(free, (left + n * size, s))
            first += n
    return out


def sharded(docs: DataFrame, *, shards: int = SHARDS, group_part: int = GROUP_PART) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``bytes``: source, language, size (log) and id are quantised and interleaved to a
    Hilbert index, and rows in its order are cut into runs. Equal texts are one shard's, with
    the least source, language and id of their group. Groups of over 1 / ``group_part`` of a
    shard (fewer than shards * group_part) are dealt first, cut only where they fit into no
    shard, and lie after a shard's run; the runs are as long as these leave room. Null texts
    count as empty, nulls in metadata come first, equal rows are rows each. Ids are taken as
    long integers; other columns are ignored.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    size = (F.octet_length(data) + 16).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(1), data).alias("k2"), lang.alias("lang"), source.alias("source"))
    rows = cut(rows, "hilbert-rows")
    facts = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    total, first_id, last_id = (int(x) for x in facts)
    room = total / shards
    cap = room / group_part
    text = ["k1", "k2"]

    groups = cut(rows.groupBy(*text).agg(F.count("*").alias("n"), F.first("size").alias("size"), *(F.min(c).alias(c) for c in ("lang", "source", "doc_id"))).withColumn("bytes", F.col("n") * F.col("size")), "hilbert-groups")
    hot = groups.filter(F.col("bytes") > cap).select(*text, "n", "size").collect()  # fewer than shards * group_part
    hot.sort(key=lambda r: (r.k1, r.k2))
    pieces = dealt_groups([(r.n, r.size) for r in hot], shards, room)
    parts = spark.createDataFrame([(r.k1, r.k2, int(-(-r.n * r.size // max(1, cap)))) for r in hot], "k1 long, k2 long, parts long")
    places = spark.createDataFrame([(hot[g].k1, hot[g].k2, first, n, s, slot) for g, first, n, s, slot in pieces], "k1 long, k2 long, first long, rows long, shard int, slot long")

    size_cell = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2("size") * 3).cast("long"))
    id_cell = F.coalesce(F.floor((F.col("doc_id") - first_id) / F.lit(float(last_id - first_id + 1)) * (1 << BITS)), F.lit(0)).cast("long")

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c, d], axis=1))) if len(a) else pd.Series([], dtype="int64")

    small = _with_cell(_with_cell(groups.filter(F.col("bytes") <= cap), rows, "source"), rows, "lang")
    small = small.withColumn("place", curve("source_cell", "lang_cell", size_cell, id_cell)).select(*text, "n", "bytes", "place")
    starts = _running(small, ["place", *text], {"n_start": "n", "b_start": "bytes"})
    ends, end = [], 0.0
    for s in range(shards):
        end += max(0.0, room - sum(n * hot[g].size for g, _, n, to, _ in pieces if to == s))
        ends.append(end)
    middle = F.col("b_start") + F.col("bytes") / 2
    shard = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= middle))).cast("int")
    starts = starts.select(*text, "n_start", shard.alias("shard"))

    in_group = Window.partitionBy(*text).orderBy("doc_id")
    own = ["doc_id", "size", "text_crc32"]
    of_run = rows.withColumn("rn", F.row_number().over(in_group) - 1) if not hot else rows.join(F.broadcast(parts), text, "left_anti").withColumn("rn", F.row_number().over(in_group) - 1)
    of_run = cut(of_run.join(starts, text).select(*own, "shard", (F.col("n_start") + F.col("rn")).alias("at")), "hilbert-shards")
    firsts = of_run.groupBy("shard").agg(F.min("at").alias("first_at"), F.count("*").alias("before"))
    out = of_run.join(F.broadcast(firsts), "shard").select(*own, "shard", (F.col("at") - F.col("first_at")).alias("slot"))
    if hot:
        dealt = rows.join(F.broadcast(parts), text).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
        before = Window.partitionBy(*text).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        subs = dealt.groupBy(*text, "sub").agg(F.count("*").alias("in_sub")).select(*text, "sub", F.coalesce(F.sum("in_sub").over(before), F.lit(0)).alias("start"))
        numbered = dealt.withColumn("rn", F.row_number().over(Window.partitionBy(*text, "sub").orderBy("doc_id")) - 1).join(subs, [*text, "sub"])
        numbered = numbered.select(*own, *text, (F.col("start") + F.col("rn")).alias("at"))
        met = numbered.join(F.broadcast(places), text).filter("at >= first AND at < first + rows")
        met = met.join(F.broadcast(firsts), "shard", "left")
        out = out.unionByName(met.select(*own, "shard", (F.coalesce("before", F.lit(0)) + F.col("slot") + F.col("at") - F.col("first")).alias("slot")))
    return out.select(*own, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
