import re
from collections import Counter

import numpy as np
import pytest
from test_simhash import brute_components, brute_print

import corpus_pipeline as C
from cairnflow.llm import boosted_rules, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéghilnorst"), int(k))) for k in rng.integers(2, 8, n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    passage = sentence(rng, 70)
    for i in range(160):
        text = "\n".join(sentence(rng, int(rng.integers(8, 16))) for _ in range(8))
        good = i % 4 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split())
        elif i % 5 == 0:
            text = text + "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    base = next(r[1] for r in rows if r[0] == 7)
    rows += [(200 + i, base, "en", "s1", len(base)) for i in range(5)] + [(300 + i, base + f" Tail{i}", None, None, 9) for i in range(4)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (rows[9][0], *rows[9][1:])]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_kept(texts, length=200):
    """Texts without the bytes of repeated runs, which keep the characters that they end inside of."""
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        text, at = "", 0
        for c in d.decode():
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        out.append(text)
    return out


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    frames = []
    for name, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, folder), f"test-{name}")
        frames.append(docs)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    judged, unique, cleaned, mixed, packed = (f.collect() for f in frames)

    model, cut_off = boosted_rules.fit_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    verdicts = boosted_rules.with_verdicts(spark.read.parquet(f"{folder}/documents.parquet"), model, cut_off, keep=["doc_id"]).filter("kept").collect()
    assert sorted(r.doc_id for r in judged) == sorted(r.doc_id for r in verdicts)
    assert {r.doc_id for r in judged if r.doc_id < 160} == {r.doc_id for r in before if r.doc_id < 160 and r.doc_id % 4}
    assert set(map(str, judged)) <= set(map(str, before))

    ids = brute_components({r.doc_id: brute_print(r.text) for r in judged})
    assert sorted(r.doc_id for r in unique) == sorted(set(ids.values()))
    assert not {200, 201, 202, 203, 204} & {r.doc_id for r in unique}

    order = sorted(unique, key=lambda r: r.doc_id)
    want = dict(zip((r.doc_id for r in order), brute_kept([r.text for r in order]), strict=True))
    assert {r.doc_id: r.text for r in cleaned} == want
    assert all(r.n_chars == len(r.text) for r in cleaned)
    assert sum(len(r.text) < len(s.text) for r, s in zip(sorted(cleaned, key=lambda r: r.doc_id), order, strict=True)) > 10

    taken = {r.doc_id: r.taken for r in mixing.mix(frames[2]).collect()}
    have = Counter()
    for r in mixed:
        have[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert have == Counter({k: v for k, v in taken.items() if v})

    texts, copies = {}, Counter()
    for r in mixed:
        copies[r.doc_id] += 1
        texts.setdefault(r.doc_id, []).append(r.text)
    once = {k: v[0] for k, v in texts.items() if len(v) == 1}
    check_rows = [p for p in packed if p.doc_id in once]
    assert {p.doc_id for p in packed} == set(texts)
    assert sum(p.length for p in check_rows) == sum(max(q.doc_tokens for q in check_rows if q.doc_id == k) for k in once)


def test_run_is_the_stages_in_order(spark, folder):
    got = C.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"} <= set(got.columns)
    assert got.count() > 0


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_each_stage_takes_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and columns of clashing names and other types, met by every stage itself."""
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [
        (1, None, None, None, None, {"a": 1}, "x"), (2, "", "en", "s1", 0, None, None), (None, "several words without an id", None, None, 3, {}, "y"), (3, "the same row twice", "en", "s1", 18, {"b": 2}, "z"), (3, "the same row twice", "en", "s1", 18, {"b": 2}, "z"),
        (4, long, "de", "s2", len(long), {}, None), (5, " \n ", "en", None, 3, None, ""), (6, "tie of ids", "en", "s1", 10, None, ""), (6, "tie of ids, another text", "en", "s1", 24, None, ""),
    ]
    docs = spark.createDataFrame(rows, f"{COLUMNS}, k1 map<string,int>, _0 string").repartition(4)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(C.STAGES)
    tell = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    given = sorted((r[0] or 0, r[1] or "") for r in rows)
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and tell(kept) == [(4, long)]
    unique = stages["simhash_dedup"](spark, docs, str(tmp_path))
    assert unique.columns == docs.columns and unique.schema == docs.schema
    assert tell(unique) == sorted(set(given) - {(2, ""), (5, " \n ")})  # null, empty and blank texts are copies
    cleaned = stages["suffix_dedup"](spark, docs, str(tmp_path))
    assert cleaned.columns == docs.columns and tell(cleaned) == given
    assert cleaned.filter("text IS NULL").count() == 1
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {None, 3, 4, 6}
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    whole = {}
    for p in packed:
        whole[p.doc_id] = whole.get(p.doc_id, 0) + p.length
    assert whole[1] == whole[2] == whole[5] == 1 and whole[3] == 2 * max(p.doc_tokens for p in packed if p.doc_id == 3) and set(whole) == {None, 1, 2, 3, 4, 5, 6}
