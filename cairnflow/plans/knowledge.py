"""Queries on texts, retrieval and judges, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import hash_embedding
from ..operators import chunking, finops, quality, retrieval
from ..sources import tables as S
from .business import TRACES

DIMENSIONS = 16
USER = {"departments": ["src0", "src1", "src2"], "clearance": 3}
#: Searches run for one who may see every document.
AUDITOR = {"departments": [f"src{i}" for i in range(20)], "clearance": 4}
SOME = "v AS (SELECT doc_id, text FROM documents WHERE source IN ('src0', 'src1', 'src2') AND doc_id % 4 + 1 <= 3)"
SEEN = f"v AS (SELECT doc_id, text FROM documents WHERE source IN ({', '.join(repr(x) for x in AUDITOR['departments'])}) AND doc_id % 4 + 1 <= 4)"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9](?:[a-z0-9\\-]*[a-z0-9])?')"
SPARSE = f"q AS (SELECT query_id, t, count(*) AS f FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS t FROM benchmark) GROUP BY 1, 2), w AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM v) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2), i AS (SELECT t, ln(1 + ((SELECT count(*) FROM v) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM w GROUP BY 1), ss AS (SELECT query_id, doc_id, round(sum(w.f * (q.f * idf)), 6) AS score FROM w JOIN q USING (t) JOIN i USING (t) GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss WHERE score > 0)"
_WORD = "('0x' || substr(sha256({0} || ':' || b), i * 8 + 1, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE * 2.0 - 1.0"
_EMBED = "(SELECT list({word} ORDER BY b, i) FROM (SELECT unnest(range(2)) AS b), (SELECT unnest(range(8)) AS i))"
DENSE = f"qe AS (SELECT item_id AS query_id, {_EMBED.format(word=_WORD.format('text'))} AS e FROM benchmark), ve AS (SELECT doc_id, {_EMBED.format(word=_WORD.format('text'))} AS e FROM v), ds AS (SELECT query_id, doc_id, round(list_cosine_similarity(qe.e, ve.e), 6) AS score FROM qe, ve), dd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.visible(S.secured_documents(spark, d), **AUDITOR).select("doc_id", "text")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _embedded(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", hash_embedding(F.col("text"), DIMENSIONS))


def rbac_documents(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.visible(S.secured_documents(spark, d), **USER).select("doc_id")


def token_tf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_frequencies(S.table(spark, d, "documents"))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.sparse_topk(_queries(spark, d), _documents(spark, d), 10)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = S.table(spark, d, "embeddings")
    return retrieval.dense_topk(rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows, 10, id_col="vec_id")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_topk(_embedded(_queries(spark, d)), _embedded(_documents(spark, d)), 5)


def rerank_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Sparse results reordered by how short their document is."""
    found = retrieval.sparse_topk(_queries(spark, d), _documents(spark, d), 20).join(_documents(spark, d), "doc_id")
    scored = found.withColumn("rerank_score", F.round(1000.0 / (F.length("text") + 1), 6)).drop("text", "score")
    return retrieval.rerank(scored, k=5, threshold=0.5)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a query's label count as relevant; the categories are the labels."""
    rows = S.table(spark, d, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    labelled = rows.select("vec_id", F.col("label").alias("category"))
    return quality.metrics_by(quality.shared_metrics(queries, dense_topk(spark, d), labelled, 10, on="category", id_col="vec_id"), "category")


def clause_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the benchmark that documents hold, and whether a line of one holds them whole."""
    docs = S.table(spark, d, "documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("content"))
    return quality.clause_integrity(S.table(spark, d, "benchmark"), lines, docs)


def clause_integrity_rate(spark: SparkSession, d: str) -> DataFrame:
    return quality.integrity_rate(clause_integrity(spark, d))


def spearman_calibration(spark: SparkSession, d: str) -> DataFrame:
    labels = S.table(spark, d, "labels").join(S.table(spark, d, "documents"), "doc_id")
    return quality.spearman(labels.select("quality", "n_chars"), "quality", "n_chars")


def judge_bias_rates(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts made up from the orders: two names and their numbers decide."""
    pick = lambda n: F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("TIE")
    o = S.table(spark, d, "orders")
    rows = o.select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), pick(F.col("o_orderkey")).alias("first"), pick(F.col("o_custkey")).alias("swapped"), (F.col("o_orderkey") % 2 == 0).alias("same_family"))
    return quality.judge_bias(rows)


def provider_benchmark(spark: SparkSession, d: str) -> DataFrame:
    priced = finops.with_cost(S.traces(spark, d), finops.pricing_table(spark))
    rows = priced.select(F.col("model").alias("provider"), "latency_ms", "completion_tokens", F.col("cache_hit").alias("correct"), (F.col("prompt_tokens") % 5 != 0).alias("success"), F.col("cost").cast("double").alias("cost"))
    return quality.provider_benchmark(rows)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    found = quality.bootstrap_ci(S.table(spark, d, "labels").select("doc_id", F.col("quality").alias("score")))
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")))


def pii_flags(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", X.pii_flags(F.col("text")).alias("p")).select("doc_id", "p.*")


def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.sanitized_query(F.col("text")), 256).alias("clean_sha256"))


def route_keywords(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.array_join(X.matched_keywords(F.col("text")), ",").alias("keywords")).filter("keywords <> ''")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each answer of a conversation against the turn before it."""
    c = S.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    pairs = c.alias("a").join(c.alias("q"), (F.col("a.conv_id") == F.col("q.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.round(X.answer_relevancy(F.col("q.text"), F.col("a.text")), 6).alias("relevancy"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(S.table(spark, d, "documents")).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha256"))


def chunk_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(S.table(spark, d, "documents"), "parent_child", pattern=r"^[A-Z]\w+\s").select("doc_id", "chunk_index", "chunk_type", "parent_index")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(S.table(spark, d, "benchmark")).select("item_id", F.posexplode("embedding").alias("position", "value")).select("item_id", "position", F.round("value", 9).alias("value"))


def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of numbers divisible by 20 ask; the vectors of all numbers are cached under their label, but as the sum of themselves and the next coordinate."""
    rows = S.table(spark, d, "embeddings").withColumn("partition_key", F.concat(F.lit("cl:"), "label"))
    moved = F.zip_with("embedding", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)), lambda x, y: x.cast("double") + y.cast("double"))
    entries = rows.withColumn("embedding", moved).select("partition_key", F.col("vec_id").alias("entry_id"), F.concat(F.lit("answer "), "vec_id").alias("response"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.array("vec_id").alias("source_doc_ids"), "embedding")
    return retrieval.cache_lookup(rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "partition_key", "embedding"), entries, threshold=0.3).withColumn("similarity", F.round("similarity", 6))


QUERIES = {f.__name__: f for f in (rbac_documents, token_tf, sparse_topk, dense_topk, hybrid_rrf, rerank_threshold, retrieval_metrics, clause_integrity, clause_integrity_rate, spearman_calibration, judge_bias_rates, provider_benchmark, bootstrap_ci, pii_flags, sanitize_text, route_keywords, sentence_split, judge_scores, chunk_fixed, chunk_parent_child, hash_embed, semantic_cache_lookup)}

_CLAUSES = "l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT item_id, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS there, EXISTS (SELECT 1 FROM l WHERE contains(l.line, b.text)) AS whole FROM benchmark b)"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_TOP = f"x AS (SELECT q.vec_id AS query_id, q.label AS category, c.vec_id, c.label, round({_COS}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x)"
_EDGE = (r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")


def _clean(text: str) -> str:
    out = f"regexp_replace({text}, '{X.CONTROLS}', '', 'g')"
    for pattern in X.INJECTION_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '', 'gi')"
    return out


_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"

ORACLES = {
    "rbac_documents": f"WITH {SOME} SELECT doc_id FROM v",
    "token_tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1, 2",
    "sparse_topk": f"WITH {SEEN}, {SPARSE} SELECT query_id, doc_id, score, rank FROM s WHERE rank <= 10",
    "dense_topk": f"WITH {_TOP} SELECT query_id, vec_id, score, rank FROM y WHERE rank <= 10",
    "hybrid_rrf": f"WITH {SEEN}, {SPARSE}, {DENSE}, u AS (SELECT query_id, doc_id, rank FROM s WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM dd WHERE rank <= 20), g AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 5",
    "rerank_threshold": f"WITH {SEEN}, {SPARSE}, t AS (SELECT query_id, doc_id, rank - 1 AS original_rank, round(1000.0::DOUBLE / (length(text) + 1), 6) AS rerank_score FROM s JOIN v USING (doc_id) WHERE rank <= 20), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) - 1 AS new_rank FROM t) SELECT query_id, doc_id, original_rank, new_rank, rerank_score FROM n WHERE new_rank < 5 AND rerank_score >= 0.5",
    "retrieval_metrics": f"WITH {_TOP}, m AS (SELECT query_id, category, count(*) FILTER (rank <= 10 AND label = category) / 10.0::DOUBLE AS p, CASE WHEN count(*) FILTER (label = category) > 0 THEN count(*) FILTER (rank <= 10 AND label = category) / (count(*) FILTER (label = category)) ELSE 0 END AS r, coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 10 AND label = category), 0) AS f FROM y GROUP BY 1, 2) SELECT category, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS reciprocal_rank FROM m GROUP BY ROLLUP (category)",
    "clause_integrity": f"WITH {_CLAUSES} SELECT item_id, whole FROM x WHERE there",
    "clause_integrity_rate": f"WITH {_CLAUSES} SELECT count(*) AS total, count(*) FILTER (whole) AS intact, round(coalesce(avg(whole::INT), 0), 6) AS rate FROM x WHERE there",
    "spearman_calibration": "WITH j AS (SELECT quality, d.n_chars FROM labels JOIN documents d USING (doc_id)), r AS (SELECT rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS y FROM j) SELECT count(*) AS n, round(corr(x, y), 6) AS correlation, round(corr(x, y), 6) >= 0.85 AS calibrated FROM r",
    "judge_bias_rates": "WITH v AS (SELECT length(o_orderpriority) AS la, length(o_orderstatus) AS lb, ['A', 'B', 'TIE'][o_orderkey % 3 + 1] AS f, ['B', 'A', 'TIE'][o_custkey % 3 + 1] AS back, o_orderkey % 2 = 0 AS fam FROM orders) SELECT count(*) AS comparisons, round(avg((f <> back)::INT), 6) AS position_bias, round(coalesce(avg(((lb > la AND f = 'B') OR (la > lb AND f = 'A'))::INT) FILTER (la > 0 AND lb > 0 AND greatest(la, lb) / least(la, lb) >= 1.5), 0), 6) AS verbosity_bias, round(greatest((avg((f = 'A')::INT) FILTER (fam AND f <> 'TIE') - 0.5) / 0.5, 0), 6) AS self_preference FROM v",
    "pii_flags": f"WITH f AS (SELECT doc_id, regexp_matches(t, '{X.EMAIL}') AS email, regexp_matches(t, '{X.PHONE}') AS phone, regexp_matches(t, '{_EDGE[0]}\\d{{11}}{_EDGE[1]}') AS national_id, regexp_matches(t, '(?i){_EDGE[0]}({X.PII_WORDS}){_EDGE[1]}') AS keyword, regexp_matches(t, '{X.NAME}') AS name, regexp_matches(t, '(?i){_EDGE[0]}pesel{_EDGE[1]}') AS pesel FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) SELECT doc_id, email, phone, national_id, keyword, name, email OR phone OR national_id OR (keyword AND (name OR pesel)) AS \"any\" FROM f",
    "bootstrap_ci": f"WITH s AS (SELECT doc_id % {quality.DRAWS} AS k, quality::DOUBLE AS s FROM labels WHERE quality IS NOT NULL), a AS (SELECT k, s, r, (k * 48271 + r * 16807 + 7) % {quality.DRAWS} AS x FROM s, range(1000) t(r)), b AS (SELECT k, s, r, (x * x + k + r) % {quality.DRAWS} AS x FROM a), c AS (SELECT k, s, r, (x * x + k + r) % {quality.DRAWS} AS x FROM b), e AS (SELECT k, s, r, (x * x + k + r) % {quality.DRAWS} AS x FROM c), n AS (SELECT s, r, {' + '.join(f'(x >= {step})::INT' for step in quality.POISSON_STEPS)} AS n FROM e), m AS (SELECT r, sum(s * n) / sum(n) AS m FROM n GROUP BY 1 HAVING sum(n) > 0), l AS (SELECT list(m ORDER BY m) AS m FROM m) SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg(s) FROM s), 9) AS mean, round(m[1 + floor(len(m) * {(1 - 0.95) / 2!r}::DOUBLE)::INT], 9) AS lower, round(m[1 + least(len(m) - 1, floor(len(m) * {(1 + 0.95) / 2!r}::DOUBLE)::INT)], 9) AS upper FROM l",
    "provider_benchmark": f"WITH {TRACES}, x AS (SELECT *, u / 1e8::DOUBLE AS cost FROM cost), y AS (SELECT model AS provider, count(*) AS n, round(avg(cache_hit::INT), 6) AS accuracy, list(latency_ms ORDER BY latency_ms) AS l, round(avg(latency_ms), 4) AS mean_ms, round(CASE WHEN sum(latency_ms) > 0 THEN sum(c) / (sum(latency_ms) / 1000) ELSE 0 END, 4) AS tokens_per_s, round(avg(cost) FILTER (p % 5 <> 0), 6) AS success_cost FROM x GROUP BY 1) SELECT provider, n, accuracy, round((l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2, 4) AS p50_ms, l[floor(n * 0.95::DOUBLE)::INT + 1] AS p95_ms, mean_ms, tokens_per_s, success_cost FROM y",
    "sanitize_text": f"SELECT conv_id, turn, sha256(substr(regexp_replace(regexp_replace({_clean('text')}, '  +', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 1, 500)) AS clean_sha256 FROM conversations",
    "chunk_fixed": "WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, pos, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w)), b AS (SELECT doc_id, pos - 1 AS f, n, coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY pos), 0) + 513 AS most FROM t), s AS (SELECT b.doc_id, b.f, b.n, greatest(coalesce(t.pos, 0), b.f + 1) AS l FROM b ASOF LEFT JOIN t ON b.doc_id = t.doc_id AND b.most >= t.g), c AS (SELECT doc_id, 0 AS i, f, l, n FROM s WHERE f = 0 UNION ALL SELECT c.doc_id, c.i + 1, s.f, s.l, s.n FROM c JOIN s ON s.doc_id = c.doc_id AND s.f = c.f + greatest(1, c.l - c.f - 10) WHERE c.l < c.n) SELECT doc_id, i AS chunk_index, sha256(array_to_string(w[f + 1 : l], ' ')) AS content_sha256 FROM c JOIN w USING (doc_id)",
    "route_keywords": "SELECT * FROM (SELECT doc_id, array_to_string(list_filter(['contract', 'invoice', 'rate', 'penalty', 'amendment', 'surcharge', 'annex', 'audit', 'compliance', 'discrepancy'], lambda k: contains(lower(text), k)), ',') AS keywords FROM documents) WHERE keywords <> ''",
    "sentence_split": "SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> ''))::BIGINT AS sentences FROM documents",
    "judge_scores": f"WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), p AS (SELECT a.conv_id, a.turn, {_W.format('q.text')} AS q, {_W.format('a.text')} AS a, len(list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda x: x <> '')) AS n FROM c a JOIN c q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1), o AS (SELECT *, CASE WHEN len(q) > 0 AND len(a) > 0 THEN len(list_intersect(q, a)) / greatest(len(q), len(a)) ELSE 0 END AS r FROM p) SELECT conv_id, turn, round(CASE WHEN r > 0.05 THEN least(1.0::DOUBLE, r * 2.0 + 0.5 + least(0.2::DOUBLE, n / 100.0::DOUBLE)) ELSE 0.15 END, 6) AS relevancy FROM o",
    "hash_embed": f"SELECT item_id, unnest(range(16))::INT AS position, round(unnest(e), 9) AS value FROM (SELECT item_id, {_EMBED.format(word=_WORD.format('text'))} AS e FROM benchmark)",
    "semantic_cache_lookup": "WITH m AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE + embedding[i % 64 + 1]::DOUBLE) AS e FROM embeddings), x AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, 'answer ' || c.vec_id AS response, round(list_cosine_similarity(q.embedding::DOUBLE[], c.e), 9) AS s FROM embeddings q JOIN m c ON q.label = c.label WHERE q.vec_id % 20 = 0), y AS (SELECT * FROM x WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) = 1) SELECT query_id, entry_id, response, round(s, 6) AS similarity FROM y WHERE s >= 0.3",
}
