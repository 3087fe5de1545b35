import numpy as np
import pytest

from pyspark.sql import functions as F

from cairnflow.llm import boosted_rules as B
from cairnflow.llm import quadratic as Q
from cairnflow.llm.doc_stats import FEATURES, labelled_sample, statistics

ROOT = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in space:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in space for c in x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) for k in range(3) if windows.count(w) > 1}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)]


def test_counts_match_brute_force():
    rng = np.random.default_rng(2)
    texts = ["", " \n\t", "one", "a b c a b c", "a a a a", "x|y <b> é# ß z", "l1\nl1\n\nl1 \n \nl1"]
    texts += [" ".join(rng.choice(["a", "b", "é", "d\n", "\x0bf", "\x1cg", "h i"], int(n))) for n in rng.integers(1, 60, 60)]
    for t in texts:
        assert statistics(t.encode())[0] == brute(t), repr(t)


def test_trees_are_monotone_and_flat_walk_agrees():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(FEATURES)))
    k = FEATURES.index("symbol_share")
    y = ((x[:, k] < 0.5) ^ (rng.random(600) < 0.15)).astype(int)
    model = B.fit_trees(x, y)
    grid = np.repeat(x[:20], 50, axis=0)
    grid[:, k] = np.tile(np.linspace(0, 1, 50), 20)
    assert (np.diff(model.raw(grid).reshape(20, 50), axis=1) <= 1e-9).all()

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.low[node] != node:
                node = model.low[node] if row[model.feature[node]] <= model.cut[node] else model.high[node]
            total += model.value[node]
        return total

    assert np.allclose(model.raw(x[:40]), [walk(r) for r in x[:40]])
    assert ((model.raw(x) > 0) == (x[:, k] < 0.5)).mean() > 0.9


def test_discriminant_is_the_difference_of_two_densities():
    rng = np.random.default_rng(1)
    x = rng.random((300, len(FEATURES)))
    y = (x[:, 0] + 0.2 * rng.standard_normal(300) > 0.5).astype(int)
    model = Q.fit(x, y)
    z = (Q.transformed(x) - model.center) / model.scale
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    logs = []
    for k in (0, 1):
        s = Q.shrunk(np.cov(z[y == k].T, bias=True), pooled)
        d = z - z[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), logs[1] - logs[0])


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")


def test_quality_held_out(spark, sample):
    docs, labels = sample
    got = Q.with_quality(docs, labels).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(test) > 50
    assert (test.predicted == test.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_rules_keep_the_good(spark, sample):
    docs, labels = sample
    model, cut_off = B.fit_rules(docs, labels)
    got = B.with_verdicts(docs, model, cut_off, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.99
    assert passed[passed.quality == 0].kept.mean() < 0.1
    assert not got[got.base_failed].kept.any()


def test_edge_rows(spark):
    good = "The first word and the other words of a long enough text go on and on with new names for each thing. " * 1
    rows = [(1, None, None, 3), (2, "", "en", 3), (None, good * 3, "en", None), (3, "w" * 300000, "en", 1), (4, " ".join(f"w{i}" for i in range(60)), None, 1), (4, " ".join(f"w{i}" for i in range(60)), None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(1, None, 0), (4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model, cut_off = B.fit_rules(docs, labels)
    got = B.with_verdicts(docs, model, cut_off, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got) == [(0, True, False), (1, True, False), (2, True, False), (3, True, False), (4, False, True), (4, False, True)]
    scored = Q.with_quality(docs, labels).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    none = docs.filter("false")
    assert Q.with_quality(none, labels).collect() == [] and B.with_verdicts(none, *B.fit_rules(none, labels.filter("false")), keep=["doc_id"]).collect() == []


def test_stage_keeps_columns(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", True), (2, "short", "en", False)], "doc_id long, text string, n_words string, kept boolean")
    assert [tuple(r) for r in B.quality_stage(spark, docs, str(tmp_path)).collect()] == [(1, text, "en", True)]


def test_rules_on_rows_that_did_not_teach(spark, sample):
    docs, labels = sample
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model, cut_off = B.fit_rules(docs, labels.filter(fold != 0))
    got = B.with_verdicts(docs, model, cut_off, keep=["doc_id"]).join(labels.filter(fold == 0), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert len(passed) > 60
    assert passed[passed.quality == 1].kept.mean() > 0.97
    assert passed[passed.quality == 0].kept.mean() < 0.2


def test_sample_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i} " * (i + 1)) for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    x, y = labelled_sample(docs.repartition(5), labels, rows=10)
    again, _ = labelled_sample(docs.repartition(2), labels, rows=10)
    assert sorted(y.tolist()) == [0, 1] and (x == again).all()


def test_every_label_teaches_the_rules(spark, monkeypatch):
    """Sums over blocks give the trees of all rows at once, and no label is left out of counts and cut-off."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.random((900, len(FEATURES))))
    y = ((x[:, 3] < 0.5) ^ (rng.random(900) < 0.1)).astype(int)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], ", ".join(["label int", *(f"{f} double" for f in FEATURES)])).repartition(7)
    cuts = B.quantile_cuts(rows, 16)
    assert all(abs((x[:, f] <= c[7]).mean() - 0.5) < 0.01 and len(c) == 15 for f, c in enumerate(cuts))
    blocks = B.in_blocks(rows, "t", B.partial(B.in_bins, cuts=cuts), np.uint8)
    over = B.partial(B.summed, blocks, kind=np.uint8)
    seen = over(lambda bins, labels: np.array([len(labels), labels.sum()]))
    assert seen.tolist() == [900, y.sum()]
    binned = B.in_bins(x, cuts)
    here = lambda measure: measure(binned, y)
    model, local = (B.boosted(o, cuts, 900, int(y.sum()), trees=5) for o in (over, here))
    assert (model.value == local.value).all() and (model.raw(x) == local.raw(x)).all() and len(model.roots) == 5
    good = np.sort(model.raw(x[y == 1]))
    found = B.reached(over, model, cuts, int(y.sum()), 0.9)
    assert (good < found).sum() <= int(0.1 * len(good) + 1e-9) and abs(found - good[int((1 - 0.9) * len(good))]) <= 2**-20
    monkeypatch.setattr(B, "labelled_rows", lambda docs, labels: rows.withColumn("label_id", F.lit(1)))
    asked = []
    monkeypatch.setattr(B, "boosted", lambda over, cuts, many, good, real=B.boosted: asked.append((many, good)) or real(over, cuts, many, good, trees=1))
    B.fit_rules(None, None)
    assert asked == [(900, int(y.sum()))]


def test_sums_leave_no_queries_with_the_driver(spark):
    rows = spark.createDataFrame([(i % 2, *[float(i)] * len(FEATURES)) for i in range(40)], ", ".join(["label int", *(f"{f} double" for f in FEATURES)])).repartition(3)
    blocks = B.in_blocks(rows, "t")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    for _ in range(3):
        assert B.summed(blocks, lambda x, y: np.array([len(y), y.sum(), x[:, 0].sum()])).tolist() == [40, 20, 780]
    bus.waitUntilEmpty()
    assert store.executionsCount() == before
