import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cairnflow.llm import hilbert as H

DOCS = "doc_id long, text string, lang string, source string, size string, sub int"


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_each_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = H.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i if i % 90 else None, "é" * int(rng.integers(1, 300)) + str(i), ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None, "x", 1) for i in range(1500)]
    rows += [(5000 + i, "copied text", "en", f"s{i % 5}", None, None) for i in range(900)] + [(7, "same row", "en", "a", "", 0)] * 400
    rows += [(8000 + i, f"pair {i // 2} of texts", "en", f"s{i}", None, None) for i in range(40)]
    rows += [(9000, None, None, None, None, None), (9001, "", "en", "s1", None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = H.sharded(docs, shards=10).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == want
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(size) == set(range(10))
    mean = sum(size.values()) / 10
    assert all(abs(v - mean) < 0.05 * mean for v in size.values()), size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(where[zlib.crc32(f"pair {k} of texts".encode())]) == 1 for k in range(20))
    again = H.sharded(docs.repartition(7), shards=10).collect()
    tell = lambda x: sorted(str((r.doc_id, r.text_crc32, r.shard, r.slot)) for r in x)
    assert tell(again) == tell(got)


def test_groups_stay_whole_at_forty_shards(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"text {i} " + "w" * int(rng.integers(0, 400)), "en", f"s{i % 9}") for i in range(6000)]
    for g, n in enumerate([2, 3, 7, 20, 60, 100, 150] * 6):
        rows += [(10000 + 1000 * g + k, f"group {g} " + "c" * 200, ["en", "de"][k % 2], f"s{k % 9}") for k in range(n)]
    rows += [(90000 + k, "a group of more than a shard " + "z" * 100, "en", "s1") for k in range(900)]
    docs = spark.createDataFrame(rows + [(200000, "long " * 400, None, None)], "doc_id long, text string, lang string, source string").repartition(5)
    got = H.sharded(docs).collect()
    shards, size, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        shards[r.text_crc32].add(r.shard)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 40
    assert len(got) == len(rows) + 1 and set(size) == set(range(40))
    assert max(abs(v - mean) for v in size.values()) < 0.04 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    many = {zlib.crc32(("a group of more than a shard " + "z" * 100).encode())}
    assert all(len(s) == 1 for k, s in shards.items() if k not in many) and 1 < len(shards[many.pop()]) < 6


def test_runs_follow_the_curve(spark):
    """Against the curve place by place, on different texts."""
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 900)) + str(i), ["de", "en", "fr", None][int(rng.integers(4))], f"s{int(rng.integers(70)):02d}") for i in range(800)]
    got = {r.doc_id: (r.shard, r.slot) for r in H.sharded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8, group_part=4).collect()}
    sources, langs = sorted({r[3] for r in rows}), [None, "de", "en", "fr"]
    cells = [(sources.index(s) * 64 // len(sources), langs.index(x) * 64 // 4, min(63, int(math.log(len(t) + 16) / math.log(2) * 3)), int(i / 800.0 * 64)) for i, t, x, s in rows]
    place = H.hilbert_index(np.array(cells))
    order = sorted(got, key=got.get)
    assert all(place[a] <= place[b] for a, b in itertools.pairwise(order))


def test_groups_are_cut_only_where_none_has_room():
    got = H.dealt_groups([(9, 10), (25, 10), (3, 30), (1, 5)], 3, 100.0)
    rows = defaultdict(int)
    for g, first, n, _, _ in got:
        assert first == rows[g]
        rows[g] += n
    assert dict(rows) == {0: 9, 1: 25, 2: 3, 3: 1}
    assert sorted(n for g, _, n, _, _ in got if g == 1) == [5, 10, 10]


def test_empty(spark):
    assert H.sharded(spark.createDataFrame([], DOCS)).collect() == []
