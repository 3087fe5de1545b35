"""The trie against a plain dictionary of prefixes and against SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from cairnflow.llm import conversation_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    """Rows of COLUMNS from a dictionary of all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(xs)] for c, xs in own.items()}
    new = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        new[c] = tuple(own.get(base, [])[:h] + xs[h:])
    members = defaultdict(list)
    for c, xs in new.items():
        for d in range(len(xs) + 1):
            members[xs[:d]].append(c)
    out = []
    for path, cs in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        childless = [p for p in inside if not any(q[:-1] == p for q in members if q)]
        ends = ",".join(map(str, sorted(c for c in cs if new[c] == path)))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in inside if p)
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), sum(q[:-1] == path for q in members if q), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in T.COLUMNS) for r in df.collect()), key=repr)


def trie(spark, rows, schema=SCHEMA, **how):
    return T.prefix_trie(T.rebuilt(T.turn_paths(spark.createDataFrame(rows, schema))), **how)


def some(seed, convs, texts=3, most=7):
    rng = np.random.default_rng(seed)
    return [(int(c), t, "ua"[t % 2], f"text {rng.integers(texts)}") for c in range(convs) for t in range(rng.integers(0, most))]


@pytest.mark.parametrize("shards", [1, 2, 5, 40])
def test_any_number_of_shards(spark, shards):
    rows = some(shards, 60)
    assert found(trie(spark, rows, shards=shards)) == plain(rows)


def test_many_equal_conversations_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    rows = [(5 * c + 10**9, t, "user", f"hello {t}") for c in range(80) for t in range(9)] + some(4, 20)
    df = trie(spark, rows, shards=7)
    assert found(df) == plain(rows)


def test_long_paths_are_cut_in_the_skeleton_only(spark, monkeypatch):
    monkeypatch.setattr(T, "SKELETON_BYTES", 1)  # 8 turns of a path
    rows = [(5 * c, t, "user", "again" if t < 40 else f"own {c % 3}") for c in range(30) for t in range(44)]
    splitters = T._splitters(T.cut(T.turn_paths(spark.createDataFrame(rows, SCHEMA)).selectExpr("conv_id", "unhex(array_join(turns, '')) AS path"), "test"), 4)
    assert splitters and all(len(p) <= 8 * T.TURN for p, _ in splitters)
    assert found(trie(spark, rows, shards=4)) == plain(rows)


def test_edge_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 3, "user", "x" * 100_000), (1, 3, "user", "a tie"), (1, 3, "assistant", "z"),
        (-7, 1, "user", "negative"), (-5, 0, "user", "base of it"), (-5, 1, "user", "next"), (None, 0, "user", "nobody's"), (0, 0, "us", "er"), (5, 0, "u", "ser"), (10, 0, "us", "er"), (11, 0, "", "ü€"), (12, 0, "é", "\x00"),
    ]
    extra = [(*r, "base", [1], 7, b"s") for r in rows]
    df = trie(spark, extra, SCHEMA + ", base string, turns array<int>, shard int, path binary", shards=3)
    assert found(df) == plain(rows)
    assert df.columns == T.COLUMNS


def test_ties_go_by_text_whatever_the_hashes(spark):
    rows = [(5, 1, "user", f"tie {k}") for k in range(12)] + [(6, 1, "user", f"tie {k}") for k in reversed(range(12))]
    assert found(trie(spark, rows)) == plain(rows)


def test_empty_and_turnless(spark):
    assert found(trie(spark, [])) == []
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(lone, 0, "user", "gone, as its base is absent")]
    assert found(trie(spark, rows)) == plain(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_given_table_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cur = db.execute(T.ORACLE_SQL)
    assert [d[0] for d in cur.description] == T.COLUMNS
    assert found(T.op11_conversation_trie(spark, folder)) == sorted(cur.fetchall(), key=repr)
