import numpy as np
import pytest
import xxhash

from cairnflow.llm import simhash as S

DOCS = "doc_id long, text string, lang string, source string, fp string"


def brute_print(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = {}
    left = dict(prints)
    while left:
        start = min(left)
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in list(left):
                if y not in group and (prints[x] ^ prints[y]).bit_count() <= 3:
                    group.add(y)
                    todo.append(y)
        for x in group:
            ids[x] = min(group)
            left.pop(x)
    return ids


def test_fingerprint_matches_brute_force():
    for text in ("", " \n", "One", "one Two", "A b c", "É É É b c", "x\x0by\x1cz w v", "the cat sat on the mat " * 9):
        assert S.fingerprint(text.encode()) == brute_print(text), text


@pytest.mark.parametrize("cap", [2, S.BUCKET_CAP])
def test_components_match_brute_force(spark, cap):
    rng = np.random.default_rng(1)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"], 120))
    rows = []
    for i in range(120):
        words = base.split() if i % 2 else list(rng.choice(["red", "blue", "green", "grey", "pink", f"w{i % 9}"], 60))
        if i % 3 == 0:
            words[int(rng.integers(len(words)))] = "edited"
        rows.append((i + 7, " ".join(words), "en", "s", "clash"))
    rows += [(200, None, None, None, None), (201, "", "en", "s", ""), (202, " \t\n", "en", "s", ""), (203, "w " * 60000, "de", None, None), (205, base, None, "s", "")]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows, DOCS), cap=cap).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    assert len(got) == len(rows)
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_components(prints)


def test_edge_rows(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d", "en", "s", ""), (3, "a b c d", "en", "s", ""), (3, "a b c d", "en", "s", ""), (None, "quite another text here today", None, None, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_masks_cover_all_close_pairs():
    rng = np.random.default_rng(0)
    for blocks in (5, 6, 7, 8, 16):
        masks = S.block_masks(blocks, blocks - 3)
        for _ in range(300):
            x = int(rng.integers(0, 1 << 62))
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(x & m == y & m for m in masks)


def test_chain_of_links_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def brute_near(texts):
    """The smallest id of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    left, kept = set(texts), set()
    while left:
        todo = [min(left)]
        kept.add(todo[0])
        left.discard(todo[0])
        while todo:
            x = todo.pop()
            near = {y for y in left if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= near
            todo += near
    return kept


@pytest.mark.parametrize("sample", [3, S.SAMPLE])
def test_stage_drops_near_copies_of_many_bits(spark, monkeypatch, sample):
    monkeypatch.setattr(S, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = [word() for _ in range(40)]
    texts, bits = {}, []
    for i in range(25):
        base = [word() for _ in range(110)] + passage
        texts[10 * i] = " ".join(base)
        for j in range(1, 6):  # up to four edits stay above 0.8, five edits and more fall below
            copy = list(base)
            for e in range(j if i % 3 else 2 * j):
                copy[7 + 12 * e] = word()
            texts[10 * i + j] = " ".join(copy)
            bits.append((S.fingerprint(texts[10 * i].encode()) ^ S.fingerprint(texts[10 * i + j].encode())).bit_count())
    texts |= {900: None, 901: "", 902: "Three short words", 903: "three  SHORT words", 904: " ".join(passage)}
    assert sum(b > 3 for b in bits) > 50
    docs = spark.createDataFrame([(k, v, "en") for k, v in texts.items()] + [(0, texts[0], "en")], "doc_id long, text string, lang string").repartition(3)
    got = S.dedup_stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(brute_near(texts))
    assert all(r.text == texts[r.doc_id] for r in got)


def test_a_round_of_components_asks_for_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    got = S.components(edges)
    jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    sc._jsc.clearJobGroup()
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(1, 41)} | {101: 100}
    assert jobs <= 60  # 72 with an exchange and a count more in each round


def test_empty_edges_have_no_components(spark):
    assert S.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_each_round_of_components_lets_go_of_the_last(spark, monkeypatch):
    rounds, released = [], []
    monkeypatch.setattr(S, "cut", lambda df, name, real=S.cut: rounds.append(name) or real(df, name))
    monkeypatch.setattr(S, "release", lambda session: released.append(session))
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")
    assert {r.node: r.root for r in S.components(edges).collect()} == dict.fromkeys(range(1, 6), 0)
    assert len(released) == len(rounds) > 1
