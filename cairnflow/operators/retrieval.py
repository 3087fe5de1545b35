"""Retrieval under row-level security: dense, sparse and fused top-k, reranking, and the semantic cache.

All functions answer a whole set of queries at once. The security filter comes first, so
it reaches the scan and no arm is filled with rows that the user may not see.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine, norm
from . import vector_index

RRF_CONSTANT = 60
PREFETCH = 4


def visible(docs: DataFrame, *, departments: list[str], clearance: int) -> DataFrame:
    """Rows of the user's departments up to their clearance. No departments is an error, as it would show nothing or all."""
    if not departments:
        raise ValueError("a user needs one department at least")
    return docs.filter(F.col("department_id").isin(departments) & (F.col("clearance_level") <= clearance))


def visible_to(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Every (user_id, document) pair that row-level security allows; users hold (user_id, departments, clearance)."""
    grants = users.select("user_id", F.explode(F.array_distinct("departments")).alias("department_id"), "clearance")
    return docs.join(grants, "department_id").filter(F.col("clearance_level") <= F.col("clearance")).drop("clearance")


def resolve_user(users: DataFrame, user_id: str) -> dict:
    """The one row of a user; an unknown id is an error."""
    found = users.filter(F.col("user_id") == user_id).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"user {user_id!r} is not known")
    return found[0].asDict()


def cleared(findings: DataFrame, clearance: int, *, missing: str = "allow") -> DataFrame:
    """Findings up to a clearance. A missing level counts as 1; with ``missing='deny'`` such rows go."""
    level = F.col("clearance_level")
    return findings.filter((F.coalesce(level, F.lit(1)) if missing == "allow" else level) <= clearance)


def top_k(scored: DataFrame, k: int, *, id_col: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The k best rows of each query, ties by id. Spark cuts to k in every partition before it shuffles."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_scores(queries: DataFrame, corpus: DataFrame, *, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query_id, id, score) of every query with every row.

    The query set is the small side; Spark broadcasts it when it is under the session's
    threshold and pairs blocks of both otherwise. Norms are computed once a vector.
    """
    q = queries.select("query_id", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_qn"))
    c = corpus.select(id_col, F.col("embedding").alias("_c"), norm(F.col("embedding")).alias("_cn"))
    score = F.round(cosine(F.col("_c"), F.col("_q"), F.col("_cn"), F.col("_qn")), digits)
    return c.crossJoin(q).select("query_id", id_col, score.alias("score"))


#: Queries that a task scores at once, and rows that it scores them on.
QUERY_BLOCK = 1024
ROW_BLOCK = 2000


def _blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The query set in blocks of about ``QUERY_BLOCK``, dealt by hash; each is small enough for the driver and every task."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k best finite scores of each column, ties by id."""
    rows, columns = [], []
    for q in range(scores.shape[1]):
        own = scores[:, q]
        if len(own) > k:
            found = np.flatnonzero(own >= np.partition(own, -k)[-k])
            found = found[np.isfinite(own[found])]
        else:
            found = np.flatnonzero(np.isfinite(own))
        found = found[np.lexsort((ids[found], -own[found]))][:k]
        rows.append(found)
        columns.append(np.full(len(found), q))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(columns)


def _scored(corpus: DataFrame, blocks: list, score: Callable, k: int, id_col: str, query_type: str) -> DataFrame:
    """The best rows of each query in each part of the corpus: ``score(block, batch)`` gives rows x queries."""
    id_type = corpus.schema[id_col].dataType.simpleString()
    schema = f"query_id {query_type}, `{id_col}` {id_type}, score double"
    out = None if blocks else corpus.sparkSession.createDataFrame([], schema)
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, ROW_BLOCK):
                    batch = whole.slice(low, ROW_BLOCK)
                    scores = score(block, batch)
                    rows, columns = _best(scores, np.array(batch.column(0).to_pylist()), k)
                    yield pa.RecordBatch.from_arrays([block["ids"].take(pa.array(columns)), batch.column(0).take(pa.array(rows)), pa.array(scores[rows, columns])], names=["query_id", id_col, "score"])

        part = corpus.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, missing elements as zeros."""
    rows = column.to_pylist()
    width = width or max((len(r) for r in rows if r), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        own = [0.0 if x is None else x for x in (r or [])[:width]]
        out[i, : len(own)] = own
    return out


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k rows most alike (cosine) to each query; the query set goes over all rows in blocks, as matrix products."""
    blocks = []
    for own in _blocks(queries.select("query_id", "embedding")):
        rows = own.toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        vectors = _matrix(rows["embedding"])
        blocks.append({"ids": pa.array(rows["query_id"].to_pylist(), rows["query_id"].type), "unit": vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)})

    def score(block: dict, batch: pa.RecordBatch) -> np.ndarray:
        own = _matrix(batch.column(1), block["unit"].shape[1])
        return np.round(own @ block["unit"].T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300), digits)

    found = _scored(corpus.select(id_col, "embedding"), blocks, score, k, id_col, queries.schema["query_id"].dataType.simpleString())
    return top_k(found, k, id_col=id_col)


def term_frequencies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sparse vector of every text: (id, term, tf), keyed by the term itself."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def inverse_document_frequencies(tf: DataFrame, n_docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(term, df, idf): ln(1 + (N - df + 0.5) / (df + 0.5)), from terms of texts or from (term, df); ``n_docs`` is a one-row frame with N in column n."""
    df = tf if "df" in tf.columns else tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(n_docs.select(F.col("n").alias("_n"))).select("term", "df", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_scores(queries: DataFrame, corpus: DataFrame, *, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query_id, id, score) by sum of query tf, text tf and idf, over the rows that share a term.

    Words of texts that no query has are dropped before anything is grouped or shuffled.
    """
    q = term_frequencies(queries, id_col="query_id")
    wanted = q.select("term").distinct()
    words = corpus.select(id_col, F.explode(tokens(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    tf = words.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    idf = inverse_document_frequencies(tf, corpus.agg(F.count("*").alias("n")), id_col=id_col)
    weighted = q.join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    scored = tf.join(weighted, "term").groupBy("query_id", id_col).agg(F.round(F.sum(F.col("tf") * F.col("weight")), digits).alias("score"))
    return scored.filter("score > 0")


def document_frequencies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df) of every term, with one shuffle by term; ``id_col`` is a text's own."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


#: Texts whose words a task codes at once.
TEXT_BLOCK = 500


def _matched(corpus: DataFrame, terms: dict[str, int], id_col: str) -> DataFrame:
    """(id, terms, tf) of every text: the numbers of its terms that queries have, and how often it has them."""
    kind = corpus.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(low, TEXT_BLOCK) for whole in batches for low in range(0, whole.num_rows, TEXT_BLOCK)):
            held = batch.column(1)
            coded = held.flatten().dictionary_encode()
            number = np.array([terms.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy())
            term = number[coded.indices.to_numpy()] if len(doc) else np.zeros(0, np.int64)
            pair, tf = np.unique(doc[term >= 0] * max(1, len(terms)) + term[term >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * max(1, len(terms))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (pair % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[id_col, "terms", "tf"])

    return corpus.select(id_col, tokens(F.col("text")).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, terms array<int>, tf array<int>")


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k rows of each query by :func:`sparse_scores`, without a row for each pair that shares a word.

    The texts are read once: what they share with the queries' terms is written to the shared
    folder, counted for the document frequencies, and then scored term by term for the
    query set in blocks, each part of the corpus on its own. Only its best rows go on, so a
    word that all texts have is no hot key. The queries' terms are known to every task.
    """
    from ..session import scratch

    spark = corpus.sparkSession
    q = term_frequencies(queries, id_col="query_id")
    terms = {t: i for i, t in enumerate(sorted(r[0] for r in q.select("term").distinct().collect()))}
    path = scratch(spark, "sparse-terms")
    _matched(corpus, terms, id_col).write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    df = np.zeros(max(1, len(terms)))
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number for each term of the queries
        df[r.t] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    blocks = []
    for own in _blocks(queries.select("query_id").distinct()):
        held = q.join(own, "query_id").select("query_id", "term", "tf").toPandas()
        if held.empty:
            continue
        ids = sorted(held["query_id"].unique().tolist())
        at = {i: n for n, i in enumerate(ids)}
        of = {terms[t]: (np.array([at[i] for i in g["query_id"]]), g["tf"].to_numpy() * idf[terms[t]]) for t, g in held.groupby("term")}
        blocks.append({"ids": pa.array(ids, pa.int64() if isinstance(ids[0], int) else pa.string()), "terms": of})

    def score(block: dict, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(block["ids"])))
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
        term, tf = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        order = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[order], prepend=-1)).tolist()
        for low, high in itertools.pairwise([*cuts, len(order)]):
            if held := block["terms"].get(int(term[order[low]])):
                out[np.ix_(doc[order[low:high]], held[0])] += np.outer(tf[order[low:high]], held[1])
        return np.where(out > 0, np.round(out, digits), -np.inf)

    found = _scored(rows, blocks, score, k, id_col, queries.schema["query_id"].dataType.simpleString())
    return top_k(found.filter("score > 0"), k, id_col=id_col)


def fuse(arms: list[DataFrame], k: int, *, id_col: str = "doc_id", constant: int = RRF_CONSTANT, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked arms: sum of 1 / (constant + rank), best k."""
    both = arms[0].select("query_id", id_col, "rank")
    for arm in arms[1:]:
        both = both.unionByName(arm.select("query_id", id_col, "rank"))
    score = F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), digits)
    return top_k(both.groupBy("query_id", id_col).agg(score.alias("score")), k, id_col=id_col)


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, *, id_col: str = "doc_id", constant: int = RRF_CONSTANT) -> DataFrame:
    """Both arms give their best 4k rows; fusion orders them.

    A query may have two texts: with ``sparse_text`` the dense arm goes by the embedding, as
    of an answer made up for it, and the sparse one by its own words.
    """
    dense = dense_topk(queries, corpus, PREFETCH * k, id_col=id_col)
    words = queries.withColumn("text", F.col("sparse_text")) if "sparse_text" in queries.columns else queries
    return fuse([dense, sparse_topk(words.select("query_id", "text"), corpus, PREFETCH * k, id_col=id_col)], k, id_col=id_col, constant=constant)


def enhanced_search(
    queries: DataFrame,
    corpus: DataFrame,
    embed: Callable[[DataFrame], DataFrame],
    k: int = 5,
    *,
    sanitize: Callable[[Column], Column] | None = None,
    classify: Callable[[Column], Column] | None = None,
    made_up: DataFrame | None = None,
    split: DataFrame | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    rerank_k: int = 20,
    threshold: float = 0.0,
    id_col: str = "doc_id",
) -> DataFrame:
    """Sanitize, route, transform, search and rerank a set of queries (query_id, text); every step but the search may be left out.

    ``classify`` gives a category (keyword, standard, vague, multi_hop). Vague queries are
    embedded by their text in ``made_up`` (query_id, text) but keep their own words for
    the sparse arm; queries of several hops are searched by their parts in ``split``
    (query_id, part, text) and the best row of each document stays. Without a router both
    apply to all queries. A keyword query is neither transformed nor reranked. A query that a
    table doesn't name, as its transformer failed, goes on with its own text; a null score,
    as the reranker failed, leaves its query in the order of the search.
    Returns (query_id, id, rank from 1, score, category, stage).
    """
    text = F.col("text") if sanitize is None else sanitize(F.col("text"))
    category = F.lit(None).cast("string") if classify is None else F.coalesce(classify(F.col("_clean")), F.lit("standard"))
    base = queries.select("query_id", text.alias("_clean")).withColumn("category", category)
    fits = lambda kind: F.col("category").isNull() | (F.col("category") == kind)
    plain = base.select("query_id", F.lit(0).alias("part"), F.col("_clean").alias("text"), F.col("_clean").alias("sparse_text"), "category")
    if made_up is not None:
        with_text = plain.join(made_up.select("query_id", F.col("text").alias("_t")), "query_id", "left")
        plain = with_text.withColumn("text", F.when(fits("vague"), F.coalesce("_t", "text")).otherwise(F.col("text"))).drop("_t")
    if split is not None:
        parts = split.select("query_id", F.col("part").alias("_part"), F.col("text").alias("_t"))
        met = plain.join(parts, (plain.query_id == parts.query_id) & fits("multi_hop"), "left").drop(parts.query_id)
        plain = met.select("query_id", F.coalesce("_part", "part").alias("part"), F.coalesce("_t", "text").alias("text"), F.coalesce("_t", "sparse_text").alias("sparse_text"), "category")
    limit = k if score is None else rerank_k
    keyed = plain.withColumn("_name", F.concat_ws(":", "query_id", "part"))
    found = hybrid_topk(embed(keyed.select(F.col("_name").alias("query_id"), "text", "sparse_text")), corpus, limit, id_col=id_col)
    merged = found.withColumnRenamed("query_id", "_name").join(keyed.select("_name", "query_id"), "_name").groupBy("query_id", id_col).agg(F.max("score").alias("score"))
    ranked = top_k(merged, limit, id_col=id_col).join(base.select("query_id", "category", "_clean"), "query_id")
    if score is None:
        return ranked.select("query_id", id_col, "rank", "score", "category", F.lit("searched").alias("stage"))
    from ..session import scratch

    path = scratch(ranked.sparkSession, "searched")
    ranked.write.parquet(path)  # it is scored and joined: one search, and the same rows for both
    ranked = ranked.sparkSession.read.schema(ranked.schema).parquet(path)
    keyword = F.coalesce(F.col("category") == "keyword", F.lit(False))
    own = Window.partitionBy("query_id")
    judged = ranked.join(score(ranked.filter(~keyword)).select("query_id", id_col, "rerank_score"), ["query_id", id_col], "left")
    judged = judged.withColumn("_again", ~keyword & (F.count("rerank_score").over(own) == F.count("*").over(own)))
    judged = judged.withColumn("_order", F.when(F.col("_again"), -F.col("rerank_score")).otherwise(F.lit(0.0)))
    judged = judged.withColumn("_rank", F.row_number().over(own.orderBy("_order", "rank")))
    judged = judged.filter((F.col("_rank") <= k) & (~F.col("_again") | (F.col("rerank_score") >= threshold)))
    final = F.when(F.col("_again"), F.col("rerank_score")).otherwise(F.col("score"))
    return judged.select("query_id", id_col, F.col("_rank").alias("rank"), final.alias("score"), "category", F.when(F.col("_again"), "reranked").otherwise("searched").alias("stage"))


def merged_results(results: list[DataFrame]) -> DataFrame:
    """Results of several sub-queries as one: each (document_id, chunk_index) once, at its best score."""
    both = results[0]
    for more in results[1:]:
        both = both.unionByName(more)
    rest = [c for c in both.columns if c not in ("query_id", "document_id", "chunk_index", "score")]
    best = both.groupBy("query_id", "document_id", "chunk_index").agg(F.max(F.struct("score", *rest)).alias("b"))
    return best.select("query_id", "document_id", "chunk_index", "b.*")


def best_documents(chunks: DataFrame, k: int) -> DataFrame:
    """Distinct documents by their best chunk, the first k of each query."""
    return top_k(chunks.groupBy("query_id", "document_id").agg(F.max("score").alias("score")), k, id_col="document_id")


def rerank(results: DataFrame, *, k: int = 5, threshold: float = 0.0, score_col: str = "rerank_score", id_col: str = "doc_id") -> DataFrame:
    """Reorder by a second score, ties by the first rank; then the threshold, then k. Ranks count from 0."""
    order = Window.partitionBy("query_id").orderBy(F.col(score_col).desc(), "original_rank")
    ranked = results.withColumn("original_rank", F.col("rank") - 1).withColumn("new_rank", F.row_number().over(order) - 1)
    return ranked.filter((F.col(score_col) >= threshold) & (F.col("new_rank") < k)).drop("rank")


def demo_relevance(query: str, base: Column, text: Column) -> Column:
    """A base score and 0.02 for each long query word that the text has, at most 0.95."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 3]
    hits = sum((F.lower(text).contains(w).cast("int") for w in words), F.lit(0))
    return F.least(base + hits * 0.02, F.lit(0.95))


def partition_key(clearance: Column, departments: Column, entities: Column) -> Column:
    """The cache's security partition: lists sorted, so that order does not matter."""
    part = lambda name, xs: F.concat(F.lit(f"{name}:"), F.array_join(F.array_sort(F.coalesce(xs, F.array().cast("array<string>"))), ","))
    return F.concat_ws("|", F.concat(F.lit("cl:"), clearance.cast("string")), part("dept", departments), part("ent", entities))


#: Entries of a cache that are all looked at, as an index would cost more.
SMALL_CACHE = 4096


def cache_lookup(queries: DataFrame, entries: DataFrame, *, threshold: float = 0.95, updates: DataFrame | None = None) -> DataFrame:
    """For each query (query_id, partition_key, embedding), the cached response most similar to it, if any.

    Only entries of the query's own partition are looked at, and of a cache over
    ``SMALL_CACHE`` entries only cells of the vector index that can hold one within the threshold. The best counts, ties go to the
    older entry. It is a miss when one of its source documents was updated after it was made.
    """
    least = max(threshold, 1e-9)
    if entries.limit(SMALL_CACHE + 1).count() <= SMALL_CACHE:
        c = entries.select("partition_key", "entry_id", F.col("embedding").alias("_c"), norm(F.col("embedding")).alias("_cn"))
        q = queries.select("query_id", "partition_key", F.col("embedding").alias("_q"), norm(F.col("embedding")).alias("_qn"))
        pairs = c.join(q, "partition_key").withColumn("similarity", F.round(cosine(F.col("_c"), F.col("_q"), F.col("_cn"), F.col("_qn")), 9)).filter(F.col("similarity") >= least)
        found = pairs.groupBy("query_id").agg(F.max_by("entry_id", F.struct("similarity", -F.col("entry_id"))).alias("entry_id"), F.max("similarity").alias("similarity"))
    else:
        centres = vector_index.fit_centroids(entries)
        index = vector_index.placed(entries.select("entry_id", "partition_key", "embedding"), centres)
        found = vector_index.best_within(queries, index, centres, least, by="partition_key", id_col="entry_id").withColumnRenamed("score", "similarity")
    facts = entries.select("partition_key", "entry_id", "response", "created_at", "source_doc_ids")
    hits = found.join(queries.select("query_id", "partition_key"), "query_id").join(facts, ["partition_key", "entry_id"])
    if updates is not None:
        newer = hits.select("query_id", "created_at", F.explode("source_doc_ids").alias("doc_id")).join(updates, "doc_id").filter("updated_at > created_at")
        hits = hits.join(newer.select("query_id").distinct(), "query_id", "left_anti")
    return hits.select("query_id", "entry_id", "response", "similarity")


def cache_evict(entries: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` entries; equal times by the higher id."""
    return entries.orderBy(F.col("created_at").desc(), F.col("entry_id").desc()).limit(most)


def cache_expire(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(F.unix_micros(now) - F.unix_micros("created_at") <= F.col("ttl_seconds") * 1_000_000)


def cache_invalidate(entries: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Entries none of whose source documents is named in ``doc_ids`` (doc_id)."""
    used = entries.select("entry_id", F.explode("source_doc_ids").alias("doc_id")).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return entries.join(used.select("entry_id").distinct(), "entry_id", "left_anti")
