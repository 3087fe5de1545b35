"""Replay of a cache's inserts and hits: which entries its size limit drops, and when."""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLAYED = "cache_id string, entry_id long, partition_key string, hits long, inserted_at long, evicted_at long"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in REPLAYED.split(", ")]


class Cache:
    """Entries in the order of their last use under each partition; beyond the limit the oldest of the partitions' first ones goes."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.born = most, 0, 0
        self.parts: dict[str, tuple[int, OrderedDict]] = {}
        self.heads: list[tuple] = []  # (created, number of the partition, partition, entry); some have moved on since

    def _note(self, part: str) -> None:
        if len(self.heads) > 4 * len(self.parts) + 1000:  # most have moved on
            self.heads = [(es[first][0], n, name, first) for name, (n, es) in self.parts.items() if es for first in [next(iter(es))]]
            heapq.heapify(self.heads)
        number, entries = self.parts[part]
        entry = next(iter(entries))
        heapq.heappush(self.heads, (entries[entry][0], number, part, entry))

    def put(self, part: str, entry: int, created: int, seq: int) -> list[tuple]:
        if part not in self.parts:
            self.born += 1
            self.parts[part] = (self.born, OrderedDict())
        entries = self.parts[part][1]
        self.size += entry not in entries
        entries[entry] = [created, seq, 0]
        if next(iter(entries)) == entry:
            self._note(part)
        out = []
        while self.size > self.most:
            out.append(self._drop())
        return out

    def hit(self, part: str, entry: int) -> None:
        entries = self.parts.get(part, (0, {}))[1]
        if entry in entries:
            first = next(iter(entries)) == entry
            entries[entry][2] += 1
            entries.move_to_end(entry)
            if first:
                self._note(part)

    def _drop(self) -> tuple:
        while True:
            created, number, part, entry = heapq.heappop(self.heads)
            held = self.parts.get(part)
            if held and held[0] == number and next(iter(held[1])) == entry and held[1][entry][0] == created:
                break
        _, seq, hits = held[1].pop(entry)
        self.size -= 1
        if held[1]:
            self._note(part)
        else:
            del self.parts[part]
        return entry, part, hits, seq

    def left(self) -> Iterator[tuple]:
        for part, (_, entries) in self.parts.items():
            for entry, (_, seq, hits) in entries.items():
                yield entry, part, hits, seq


def cache_replay(trace: DataFrame, most: int) -> DataFrame:
    """REPLAYED rows of a trace (cache_id, seq, kind, partition_key, entry_id, created_at): each insert with its hits and the step that dropped it, null if it is still there.

    ``kind`` is put or hit. A hit moves its entry to the end of its partition; a hit on
    an entry that is gone counts for nothing. A put over ``most`` entries drops the oldest, by
    created_at, among the partitions' first ones; ties go to the partition that began first.
    A cache is sequential by nature: a task walks the sorted steps of its caches and holds
    ``most`` entries, whatever the trace's length, and caches run beside one another. An
    entry that is put again while it is there keeps its place and starts anew.
    """
    rows = trace.select(F.col("cache_id").cast("string").alias("cache_id"), F.col("seq").cast("long").alias("seq"), (F.col("kind") == "put").alias("put"), F.col("partition_key").cast("string").alias("part"), F.col("entry_id").cast("long").alias("entry"), F.unix_micros("created_at").alias("created"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache, out = None, None, []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for name, seq, put, part, entry, created in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cache is None or name != own:
                    out += [(own, *r, None) for r in cache.left()] if cache else []
                    own, cache = name, Cache(most)
                if put:
                    out += [(own, *r, seq) for r in cache.put(part, entry, created, seq)]
                else:
                    cache.hit(part, entry)
            yield told(out)
            out = []
        yield told([(own, *r, None) for r in cache.left()] if cache else [])

    return rows.repartition("cache_id").sortWithinPartitions("cache_id", "seq").mapInArrow(run, REPLAYED)
