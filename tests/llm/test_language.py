"""The recurrent network against loops and numeric gradients, and languages of held-out documents."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import language as L

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def network():
    net = L.Network.fresh(["a", "b", "c"], 4, 3)
    rng = np.random.default_rng(0)
    net.shift[:], net.bias[:] = rng.standard_normal(net.shift.shape), rng.standard_normal(net.bias.shape)
    return net


def plain_probabilities(net, symbols):
    """(bytes, languages) of one segment, one unit after another."""
    h = net.hidden.shape[2]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def one_way(way, seq):
        state, out = np.zeros(h), []
        for c in seq:
            x, a = net.inputs[way][:, c].astype(float), net.hidden[way].astype(float) @ state
            z, r = sig(x[:h] + a[:h]), sig(x[h : 2 * h] + a[h : 2 * h])
            n = np.tanh(x[2 * h :] + r * (a[2 * h :] + net.shift[way][:, 0]))
            state = (1 - z) * n + z * state
            out.append(state)
        return np.array(out)

    scores = one_way(0, symbols) @ net.weights[0].T + one_way(1, symbols[::-1])[::-1] @ net.weights[1].T + net.bias[:, 0]
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("size", [1, 5, 63, 64, 65, 127, 128, 200, 1000])
def test_every_byte_counts_once(network, size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    found = network.document_probabilities([b"", data, b"xy", data])
    rows = []
    for k in range(0, size, L.STEPS):
        start = max(0, min(k, size - L.STEPS))
        segment = list(data[start : start + L.STEPS])
        p = plain_probabilities(network, segment + [L.PAD] * (L.STEPS - len(segment)))
        rows.append(p[k - start : len(segment)])
    wanted = np.concatenate(rows)
    assert len(wanted) == size
    assert np.allclose(found[1], wanted.mean(axis=0), atol=1e-4) and np.array_equal(found[1], found[3])
    assert not found[0].any() and found[2].sum() == pytest.approx(1, abs=1e-5)


def test_gradients_are_those_of_the_loss(network):
    rng = np.random.default_rng(1)
    for name in ("inputs", "hidden", "shift", "weights", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    symbols, target, counted = rng.integers(0, 257, (7, 6)), rng.integers(0, 3, 6), (rng.random((7, 6)) < 0.8).astype(float)
    _, grads = network.gradients(symbols, target, counted)
    for p, g in zip(network.parameters(), grads, strict=True):
        assert g.shape == p.shape
        for flat in np.argsort(-np.abs(g).ravel())[:5]:
            at, old = np.unravel_index(flat, p.shape), p.flat[flat]
            p[at] = old + 1e-3
            up, _ = network.gradients(symbols, target, counted)
            p[at] = old - 1e-3
            down, _ = network.gradients(symbols, target, counted)
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-5)


def test_training_tells_alphabets_apart():
    rng = np.random.default_rng(2)
    make = lambda letters, n: bytes(rng.choice(list(letters), n).tolist())
    windows = [make(b"abcd ", 64) for _ in range(40)] + [make(b"cdef ", 64) for _ in range(40)]
    net = L.train(windows, np.repeat([0, 1], 40), ["x", "y"], batches=40, batch=32)
    p = net.document_probabilities([make(b"abcd ", 300), make(b"cdef ", 300), b"abba", b"fee"])
    assert p.argmax(axis=1).tolist() == [0, 1, 0, 1]
    again = L.train(windows, np.repeat([0, 1], 40), ["x", "y"], batches=40, batch=32)
    assert all(np.array_equal(a, b) for a, b in zip(net.parameters(), again.parameters(), strict=True))


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    windows, names = L.sample_windows(docs)
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    texts = [r.text.encode() for r in docs.collect() if r.doc_id not in held and r.text]
    assert windows and all(any(w in t for t in texts) for w in windows[::97]) and max(map(len, windows)) == L.STEPS
    rows = L.with_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.held_out} == held
    assert all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.lang is not None and r.text]
    assert len(known) > 250 and sum(r.lang == r.lang_pred for r in known) / len(known) >= 0.97


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"word {k} of some text", "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(L._fold(F.col("doc_id")) == 1, "zz").otherwise(F.col("lang")))
    assert L.sample_windows(docs) == L.sample_windows(other)
    assert L.sample_windows(docs) == L.sample_windows(docs.repartition(7))
    assert len(L.sample_windows(docs, rows=3)[0]) <= 6


EDGES = "doc_id long, text string, lang string, _lang int, _n int, told string, data int"


def test_edge_rows(spark):
    long = "Is and ouen the of " * 20000
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 $ \n", "en"), (4, long, "en"), (5, "the of and", "en"), (5, "the of and", "en"), (None, "und der die", "de"), (8, "der die das ü", "de"), (9, "einer der zu", "de"), (10, " ", None), (11, "Ω", None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], EDGES)
    net = L.fitted(docs, batches=5)
    got = L.with_language(docs, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in (1, 2, 3, 10):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[11].lang_pred in ("de", "en") and by[None].held_out is None and by[4].lang_pred in ("de", "en")
    twice = [r for r in got if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_one_language_none_and_no_rows(spark):
    one = spark.createDataFrame([(k, "some words", "en") for k in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 6)) for r in L.with_language(one).collect()} == {("en", 1.0)}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.with_language(none).collect()} == {("und", 0.0)}
    assert L.with_language(one.filter("false")).collect() == []
