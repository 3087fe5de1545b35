import hashlib
from collections import Counter

import numpy as np
import pytest

from cairnflow.llm import suffix_dedup as D

DOCS = "doc_id long, text string, k1 string, h long, n_bytes string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def messy(seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "né", "gamma", "ß", "delta", "x", "of"]
    say = lambda n: " ".join(rng.choice(words, n)) + "".join(rng.choice(list("abcdefgh"), 4))
    passage, base = say(60), say(250)
    texts = []
    for i in range(60):
        t = say(int(rng.integers(1, 120)))
        if i % 3 == 0:
            t += passage[int(rng.integers(0, 20)) : len(passage) - int(rng.integers(0, 20))] + say(40)
        if i % 4 == 0:
            t = base[:400] + str(i) + base[400:900] + "!" * (i % 5) + base[900:]
        texts.append(t)
    return [*texts, None, "", "a" * 199, "b" * 200, "c" * 201, "ab" * 900, "xyz " * 60 + passage * 2, texts[5], texts[5], "é" * 150, "q" * 70000, *texts[:2]]


@pytest.mark.parametrize(("length", "gram", "cap"), [(200, 100, 20000), (60, 16, 20000), (60, 16, 3)])
def test_matches_brute_force(spark, length, gram, cap):
    texts = [t for t in messy(length + cap) if length == 200 or len(t or "") < 60000]
    rows = [(i if i % 7 else None, t, None, 5, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = D.without_repeats(frame, length=length, gram=gram, cap=cap, inline=2 if cap == 3 else 4, held=1 if length == 60 else 1 << 16).collect()
    tell = lambda rows: sorted(map(str, rows))
    want = brute(texts, length)
    assert tell((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == tell((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_marks_are_all_least_grams():
    rng = np.random.default_rng(3)
    for n in (10, 59, 60, 61, 500, 70000):
        data = rng.integers(97, 100, n).astype(np.uint8)
        at, h = D.marked_grams(data, 60, 16)
        full = np.concatenate([D.window_hashes(data[i : i + 60000], 16)[: 60000 - 15] for i in range(0, max(1, n - 15), 60000 - 15)]) if n >= 16 else np.zeros(0, np.uint64)
        want = set()
        for i in range(max(0, n - 59)):
            run = full[i : i + 45]
            want |= {i + int(j) for j in np.flatnonzero(run == run.min())}
        assert set(at.tolist()) == want
        assert all(full[a] == x for a, x in zip(at, h.view(np.uint64), strict=True))


def test_maximal_repeats_have_all_occurrences():
    pieces = [b"1xxABCDEFGHyy", b"2xxABCDEFGHzz", b"3qqABCDEFGHyy", b"4__CDEFGH__"]
    found = {(n, tuple(sorted(p.tolist()))) for n, p, _ in D.maximal_repeats(pieces, [5, 5, 5, 3], [9] * 4, 6)}
    assert found == {(10, (0, 1)), (8, (0, 1, 2)), (10, (0, 2)), (6, (0, 1, 2, 3))}


def test_empty_table(spark):
    assert D.without_repeats(spark.createDataFrame([], DOCS)).collect() == []
