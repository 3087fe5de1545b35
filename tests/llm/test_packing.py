import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairnflow.llm import packing as P

TOKENIZER = Tokenizer.from_file(P.tokenizer_path())


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, texts, window):
    """Every id of every document in one piece, sequences without gaps and full or of a power of two."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0 or at == window
    assert set(documents) == set(texts)
    for doc, own in documents.items():
        ids, at = whole(texts[doc]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    return sequences


@pytest.mark.parametrize(("shard_tokens", "sample"), [(1500, 40), (P.SHARD_TOKENS, P.SAMPLE)])
def test_pieces(spark, shard_tokens, sample):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ba", "Ké", "st", "日本") for b in ("n", "ro", "'s", "7", "")]
    texts = {i: " ".join(rng.choice(words, int(n))) for i, n in enumerate(rng.integers(0, 200, 150))}
    texts |= {500: None, 501: "", 502: "\x1c \x0b", 503: "long text " * 9000, 504: "<|endoftext|> a", None: "without id"}
    rows = [(k, v, "clash", 1) for k, v in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, data int").repartition(3)
    got = P.pack(docs, shard_tokens=shard_tokens, sample=sample, ids=True).collect()
    sequences = check(got, texts, P.WINDOW)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in got)
    if shard_tokens == P.SHARD_TOKENS:
        assert len(sequences) <= sum(len(whole(t)) for t in texts.values()) // P.WINDOW + 13


def bm25(items, seed, df, n, mean):
    """Scores of all items for the terms of one, by the formula."""
    score = np.zeros(len(items))
    for d, x in enumerate(items):
        for t in set(items[seed].tolist()):
            tf = int((x == t).sum())
            score[d] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return score


def test_neighbours_follow_bm25():
    items = [np.array(x) for x in ([1, 2, 3, 9], [1, 2, 3, 4], [5, 6, 7], [1, 5, 5, 8], [7, 7, 7, 7])]
    df, n, mean = np.array([0, 30, 2, 5, 9, 1, 1, 2, 3, 40]), 50, 3.5  # of a corpus that these are a shard of
    index, score = P.Index(items, P.idf_of(df, n), mean), bm25(items, 0, df, n, mean)
    want = [i for i in np.argsort(-score, kind="stable") if i and score[i] > 0]
    assert index.neighbours(0, np.array([False, True, True, True, True])).tolist() == want
    assert index.neighbours(0, np.array([False, False, True, True, True])).tolist() == [3]


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(P, "WORD_CACHE", 60)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé.,#1"), int(n))) for n in rng.integers(1, 7, 120)]
    W = P.WordTokenizer(P.tokenizer_path())
    for _ in range(60):
        texts = [" ".join(rng.choice(words, 8)) for _ in range(2)]
        assert [np.frombuffer(c, "<u2").tolist() for c in W.encode(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()] == [whole(t) for t in texts]
        assert len(W.hash) <= 60 + 40 and (np.diff(W.hash.astype(object)) > 0).all()


def test_index_equals_brute_force():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 300, int(n)) for n in rng.integers(1, 60, 200)]
    df = np.array([sum(t in set(x.tolist()) for x in items) for t in range(300)])
    mean = float(np.mean([len(x) for x in items]))
    index = P.Index(items, P.idf_of(df, 200), mean)
    for seed in range(0, 200, 20):
        score, unused = bm25(items, seed, df, 200, mean), np.ones(200, bool)
        unused[seed] = False
        got = index.neighbours(seed, unused)[:10]
        score[seed] = 0
        assert np.allclose(score[got], np.sort(score)[::-1][: len(got)], rtol=1e-4)


def test_windows_hold_neighbours():
    rng = np.random.default_rng(0)
    docs = [rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 256) for i in range(64)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    rows = P.pack_shard(docs, P.idf_of(df, 64), 256.0)
    kinds = [{d % 4 for d, _, _ in row} for row in rows]
    assert len(rows) == 4 and all(len(k) == 1 for k in kinds)


def test_tree_keeps_near_copies_together():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 2000, 300) for _ in range(600)]
    near = [np.where(rng.random(300) < 0.03, rng.integers(0, 2000, 300), d) for d in docs]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2000)
    idf = P.idf_of(df, 600)
    tree = P.fit_tree(P.vectors(P.counted(docs[:300]), idf), depth=5)
    (a, x), (b, y) = (tree.places(P.vectors(P.counted(d), idf)) for d in (docs, near))
    place = np.argsort(np.lexsort((np.concatenate([x, y]), np.concatenate([a, b]))))
    assert np.median(np.abs(place[:600] - place[600:])) < 60  # of 1,200
    assert sorted(set(a.tolist())) == list(range(32))


def test_words_equal_whole_texts():
    rng = np.random.default_rng(1)
    parts = ["a", "B", " ", "\n", "\x0b", "\x1c", " ", "é", "é", "23", "'ll", "!", "<|endoftext|>", "Σ", "日本", "😀", "</w>", "\x85", "-", ".", ",", "?!", "T", "J\u030c", "H\u0331", "İ", "K", "ß", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 14, 6000)]
    coded = P.WordTokenizer(P.tokenizer_path()).encode(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
    assert all(np.frombuffer(c, "<u2").tolist() == whole(t) for c, t in zip(coded, texts, strict=True))


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "same words", "x")] * 5, "doc_id long, text string, lang string")
    got = P.pack(docs).collect()
    assert sum(p.length for p in got) == 5 * len(whole("same words"))
    assert P.pack(docs.filter("false")).collect() == []
