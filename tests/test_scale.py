"""Steps whose memory must not grow with one key, one batch or one group."""

import pyarrow as pa

from pyspark.sql import functions as F

from cairnflow.operators import chunking, compliance, ordered, quality, retrieval
from test_platform import entries


def test_a_long_chain_is_built_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", 10)
    for chains in (1, 7):
        rows = entries(spark, 1200, chains).withColumn("chain_id", F.when(F.col("chain_id") != "chain 2", F.col("chain_id")))
        sizes, real = [], compliance._walked
        monkeypatch.setattr(compliance, "_walked", lambda r, chain, handed: sizes.append(r.groupBy(chain).count().agg(F.max("count")).first()[0]) or real(r, chain, handed))
        cut = compliance.build_chains(rows, walked=200)
        assert len(sizes) > 2 and max(sizes[:-1]) < 400
        monkeypatch.setattr(compliance, "_walked", real)
        whole = compliance.build_chains(rows)
        assert cut.schema == whole.schema
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_metrics_by_a_shared_value_need_no_pairs(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "query_id long, category string")
    docs = spark.createDataFrame([(10, "a"), (11, "a"), (11, "b"), (12, "b"), (13, None), (10, "a")], "doc_id long, category string")
    found = spark.createDataFrame([(q, i, r) for q in (1, 2, 3, 4) for r, i in enumerate((13, 12, 11, 11), 1)], "query_id long, doc_id long, rank int")
    relevant = docs.join(queries, "category").select("query_id", "doc_id")
    old = quality.retrieval_metrics(queries, found, relevant, 2)
    new = quality.shared_metrics(queries, found, docs, 2, on="category")
    assert sorted(map(str, old.select(sorted(old.columns)).collect())) == sorted(map(str, new.select(sorted(old.columns)).collect()))
    assert new.agg(F.sum("recall")).first()[0] == 0.5


def test_the_plan_of_retrieval_metrics_makes_no_pairs(spark):
    rows = spark.createDataFrame([(i, "a") for i in range(400)], "vec_id long, category string")
    queries = rows.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "query_id")
    top = rows.limit(1).select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(1).alias("rank"))
    name = quality.shared_metrics(queries, top, rows, 10, on="category", id_col="vec_id")
    assert name.filter("query_id = 0").first().recall == 1 / 400


def test_chunks_leave_a_batch_in_parts(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(chunking, "HELD", 1000)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: sent.append(run))
    chunking.chunked(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), size=50, overlap=0)
    texts = pa.array(["word " * 300, None, " ", "one two"])
    parts = list(sent[0](iter([pa.RecordBatch.from_arrays([pa.array(range(4)), texts], names=["_d", "_t"])])))
    assert len(parts) > 1 and max(sum(map(len, p.column(4).to_pylist())) for p in parts) <= 1050
    rows = [r for p in parts for r in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(4).to_pylist(), strict=True)]
    assert rows == [(n, i, c) for n, t in enumerate(texts.to_pylist()) for i, (c, _, _) in enumerate(chunking.fixed_chunks(t or "", size=50, overlap=0))]


def test_words_are_coded_some_texts_at_a_time(spark, monkeypatch):
    sent = []
    docs = spark.createDataFrame([(i, "a b a") for i in range(3)], "doc_id long, text string")
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, run, schema: sent.append(run))
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 2)
    retrieval._matched(docs, {"a": 0, "c": 1}, "doc_id")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([["a", "b", "a"], ["b"], ["c", "a"]])], names=["doc_id", "t"])
    parts = list(sent[0](iter([batch])))
    assert [p.num_rows for p in parts] == [2, 1]
    assert [(r["doc_id"], r["terms"], r["tf"]) for p in parts for r in p.to_pylist()] == [(1, [0], [2]), (2, [], []), (3, [0, 1], [1, 1])]


def test_a_batch_of_the_stream_is_in_several_files(spark, tmp_path, monkeypatch):
    from cairnflow.plans import streams

    given = spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(4)
    given.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    files, rows = [], []
    for raw in streams._arrived(spark, str(tmp_path), "sent"):
        assert raw.isStreaming
        sent = spark.read.parquet(f"{tmp_path}/sent")
        files.append(len(sent.inputFiles()))
        rows.append(sent.count())
    assert len(files) == 3 and files[0] > 1 and files[2] > files[1] > files[0]
    assert rows[0] < rows[1] < rows[2] == given.count()
