import re

import numpy as np
import pytest

from cairnflow.llm import mixing as M


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5, 1 << 31):
            assert sorted(M.permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))
    n = 5000
    assert (M.permuted(np.arange(n), np.full(n, n), np.full(n, 1)) != M.permuted(np.arange(n), np.full(n, n), np.full(n, 2))).mean() > 0.9


def fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        live = sum(weight[s] for s in order if s not in capped)
        got = {s: 3 * sizes[s] if s in capped else rest * weight[s] / live for s in order}
        over = {s for s in order if got[s] > 3 * sizes[s]} - capped
        if not over:
            return got
        capped |= over


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        source = ["b", "a", None, "", "é", "zz", "tiny"][int(rng.choice(7, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.09, 0.01]))]
        rows.append((i if i % 50 else None, " ".join(f"w{j}" for j in range(int(rng.integers(0, 400)))), "en", source, "clash"))
    rows += [(9000, None, None, "a", None), (9001, " \n ", None, "b", ""), (9002, "long " * 30000, "de", "a", ""), (9003, "x\x1cy z\x0bq", "de", "only", ""), (9004, "", "en", "none", "")]
    rows += [(9005, "same row here", "en", "b", "")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, sid string").repartition(5)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_taken(rows, seed=M.SEED):
    """Words taken of each row, slot by slot, from the order of rows in their source, for sources of one part's order."""
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(words(r.text) for r in rows if r.source == s) for s in order}
    goal, out = fill(sizes), {}
    for sid, s in enumerate(order):
        blocks = -(-sizes[s] // M.BLOCK_WORDS)
        slots = min(round(goal[s] * blocks / max(1, sizes[s])), 3 * blocks)
        out[s] = np.zeros(blocks * M.BLOCK_WORDS, int)
        for i in range(slots):
            key = M._key(seed, sid, i // blocks)
            b = int(M.permuted(np.array([i % blocks]), np.array([blocks]), np.array([key]))[0])
            out[s][b * M.BLOCK_WORDS : (b + 1) * M.BLOCK_WORDS] += 1
        out[s] = out[s][: sizes[s]]
    return order, out


def test_taken_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), str(rng.choice(["a", "b", "c"])) if i % 9 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order, times = brute_taken(docs.collect())
    sizes = M.sized(docs)
    at = {r.doc_id: (order[r.sid], r.at) for r in M.placed(sizes, M.targets(sizes)).collect()}
    got = {r.doc_id: r.taken for r in M.mix(docs).collect()}
    assert got == {i: int(times[at[i][0]][at[i][1] : at[i][1] + words(t)].sum()) for i, t, _ in rows}


def test_mix(spark, docs):
    got = M.mix(docs).collect()
    rows = docs.collect()
    tell = lambda x: sorted((a or -1, b) for a, b in x)
    assert tell((r.doc_id, r.size) for r in got) == tell((r.doc_id, words(r.text)) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = fill(sizes)
    assert sorted({(r.source_size, round(r.target, 3)) for r in got}) == sorted({(sizes[s], round(t, 3)) for s, t in want.items()})
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = {}
    for r in got:
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    for (size, target), n in taken.items():
        assert abs(n - target) <= max(2 * M.BLOCK_WORDS, 0.01 * target), (size, target, n)
    slots = M.mixed_slots(M.targets(M.sized(docs))).toPandas()
    assert {r.shard for r in got if r.taken} <= set(slots.shard) and all((r.shard is None) == (not r.taken) for r in got)
    firsts = {(r.shard, r.place) for r in got if r.taken}
    assert firsts <= set(zip(slots.shard, slots.place, strict=True))
    again = M.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_are_whole_epochs_of_blocks(spark):
    sources = spark.createDataFrame([(0, 7, 17), (1, 500, 200), (2, 1, 3), (3, 0, 0)], "sid long, blocks long, slots long")
    got = M.mixed_slots(sources, shard_slots=44).toPandas()
    for sid, blocks, slots in ((0, 7, 17), (1, 500, 200), (2, 1, 3)):
        own = got[got.sid == sid].sort_values("slot")
        assert own.slot.tolist() == list(range(slots))
        assert (own.groupby("epoch").block.nunique() == own.groupby("epoch").block.size()).all()
        assert own.block.between(0, blocks - 1).all()
    assert got.shard.between(0, 4).all() and got.shard.nunique() == 5
    assert all(sorted(own.place) == list(range(44)) for _, own in got.groupby("shard"))
    assert M.mixed_slots(sources.filter("false")).collect() == []


def test_strata_take_even_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "STRATUM_SLOTS", 60)
    sources = spark.createDataFrame([(0, 7, 17), (1, 500, 200), (2, 1, 3)], "sid long, blocks long, slots long")
    got = M.mixed_slots(sources, shard_slots=20).toPandas()
    assert sorted(zip(got.sid, got.slot, strict=True)) == [(s, i) for s, n in ((0, 17), (1, 200), (2, 3)) for i in range(n)]
    assert not got.duplicated(["shard", "place"]).any() and got.groupby("shard").size().max() <= 20


def test_counts_of_shards_are_multinomial():
    slots, edges = np.array([50_000, 30_000, 20_000]), np.arange(0, 100_001, 1000)
    got = list(M.shard_counts(slots, edges, 0, 100, (1, 0)))
    counts = np.array([n for _, n, _ in got])
    assert [j for j, *_ in got] == list(range(100)) and (counts.sum(axis=1) == 1000).all() and (counts.sum(axis=0) == slots).all()
    assert (np.array([b for *_, b in got]) == np.cumsum(counts, axis=0) - counts).all()
    share = slots / slots.sum()
    assert np.allclose(counts.var(axis=0), 1000 * share * (1 - share), rtol=0.5)
    part = list(M.shard_counts(slots, edges, 40, 48, (1, 0)))
    assert all(a == c and (b == d).all() for (a, b, _), (c, d, _) in zip(part, got[40:48], strict=True))
    other = np.array([n for _, n, _ in M.shard_counts(slots, edges, 0, 100, (2, 0))])
    assert (other != counts).any()


def test_stage_gives_the_words_that_the_mix_takes(spark, docs):
    base = docs.withColumn("n_chars", docs.doc_id)
    got = M.mixing_stage(spark, base, "").collect()
    assert list(got[0].asDict()) == base.columns
    want, have = {}, {}
    for r in M.mix(base).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text) and r.text
    assert have == {k: v for k, v in want.items() if v}


def test_empty(spark, docs):
    assert M.mix(docs.filter("false")).collect() == []
    assert M.mixing_stage(spark, docs.filter("false"), "").collect() == []
