"""Queries on invoices, costs and the audit log, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, compliance, finops
from ..session import scratch
from ..sources import tables as S

K = "coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0)"
MODEL = "CASE k % 3 WHEN 0 THEN 'gpt-5-nano' WHEN 1 THEN 'gpt-5-mini' ELSE 'gpt-5.2' END"
ENTRIES = f"e AS (SELECT *, {K} AS k FROM events), a AS (SELECT event_id AS id, ts AS created_at, 'user-' || user_id AS user_id, event_type AS department, {MODEL} AS model_version, 'query ' || props AS query_text, 'response ' || event_id AS response_text, CASE WHEN k % 5 = 0 THEN 'full_trace' WHEN k % 5 < 3 THEN 'summary' ELSE 'metadata_only' END AS log_level, CASE WHEN k % 4 = 0 THEN 'approver-' || (k % 3) END AS hitl_approver_id, k % 10 = 0 AS is_degraded FROM e)"
TRACES = f"e AS (SELECT *, {K} AS k FROM events), t AS (SELECT event_id AS trace_id, event_type AS agent_name, {MODEL} AS model, CAST(floor(value * 100) AS BIGINT) AS p, CAST(k AS BIGINT) AS c, value AS latency_ms, k % 7 = 0 AS cache_hit, CASE WHEN k % 11 <> 0 THEN user_id END AS user_id, ts FROM e), cost AS (SELECT *, CASE WHEN cache_hit THEN 0 ELSE CASE model WHEN 'gpt-5-nano' THEN p * 5 + c * 40 WHEN 'gpt-5-mini' THEN p * 25 + c * 200 ELSE p * 175 + c * 1400 END END AS u FROM t)"
LINES = "l AS (SELECT l_orderkey AS invoice_id, l_linenumber AS line_item_index, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem), m AS (SELECT *, (cents * 200 + q) // (2 * q) AS price4 FROM l), d AS (SELECT invoice_id, line_item_index, l_partkey AS cargo_type, CAST(round(p_retailprice * 10000) AS BIGINT) AS rate4, price4, q, cents FROM m JOIN part ON p_partkey = l_partkey), x AS (SELECT *, cents * 100 - rate4 * q AS diff4, round((price4 - rate4) / 10000.0::DOUBLE / (rate4 / 10000.0::DOUBLE) * 100, 4) AS percentage FROM d WHERE rate4 <> 0 AND cents * 100 <> rate4 * q), b AS (SELECT *, CASE WHEN abs(percentage) < 1 THEN 0 WHEN abs(percentage) < 5 THEN 1 WHEN abs(percentage) < 15 THEN 2 ELSE 3 END AS o FROM x)"
BANDS = "['auto_approve', 'investigate', 'escalate', 'critical']"


def _found(spark: SparkSession, d: str) -> DataFrame:
    return audit.discrepancies(S.invoice_lines(spark, d), S.contract_rates(spark, d))


def audit_discrepancies(spark: SparkSession, d: str) -> DataFrame:
    out = _found(spark, d)
    return out.select("invoice_id", "line_item_index", "cargo_type", F.col("expected_rate").cast("double"), F.col("actual_rate").cast("double"), F.col("difference").cast("double"), "percentage", "band")


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    headers = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.concat(F.lit("customer "), "o_custkey").alias("vendor"), F.lit("EUR").alias("currency"))
    return audit.report(headers, _found(spark, d)).withColumn("total_discrepancy", F.col("total_discrepancy").cast("double"))


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return finops.with_cost(S.traces(spark, d), finops.pricing_table(spark))


def cost_by_agent(spark: SparkSession, d: str) -> DataFrame:
    return finops.cost_by(_costs(spark, d), "agent_name").withColumn("total_cost", F.col("total_cost").cast("double"))


def cost_by_user(spark: SparkSession, d: str) -> DataFrame:
    return finops.cost_by(_costs(spark, d), "user_id").withColumn("total_cost", F.col("total_cost").cast("double"))


def cost_summary_period(spark: SparkSession, d: str) -> DataFrame:
    own = finops.in_period(_costs(spark, d), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return finops.cost_summary(own).select(F.col("total_cost").cast("double"), "total_queries", "avg_cost", "cache_hit_rate", F.array_join(F.transform(F.map_entries("by_agent"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(18,8)").cast("string"))), ",").alias("by_agent"))


def drift_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Weekly mean latency and cache rate of each model, every later week against the first."""
    weeks = S.traces(spark, d).withColumn("week", F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7))
    means = weeks.groupBy("model", "week").agg(F.avg("latency_ms").alias("latency"), F.avg(F.col("cache_hit").cast("double")).alias("cache"))
    long = means.select("model", "week", F.explode(F.create_map(F.lit("latency"), F.round(F.col("latency") / 20, 6), F.lit("cache"), F.round("cache", 6))).alias("metric", "score"))
    return finops.drift_alerts(long.filter("week = 0").drop("week"), long.filter("week > 0"))


def drift_worst(spark: SparkSession, d: str) -> DataFrame:
    return finops.worst_severity(drift_alerts(spark, d))


def prompt_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return finops.prompt_cache(S.traces(spark, d).select(F.concat_ws("|", "user_id", "agent_name").alias("partition_key")))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "STATIC").when(F.col("role") == "assistant", "SESSION_STABLE").otherwise("DYNAMIC")
    return S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("position")).agg(F.min(kind).alias("section_type"), F.min("text").alias("content"))


def cache_friendliness(spark: SparkSession, d: str) -> DataFrame:
    return finops.cache_friendliness(_sections(spark, d))


def compliance_summary(spark: SparkSession, d: str) -> DataFrame:
    return compliance.period_stats(S.audit_entries(spark, d))


def compliance_report(spark: SparkSession, d: str) -> DataFrame:
    found = compliance.compliance_report(S.audit_entries(spark, d).withColumn("total_cost_eur", (F.col("id") % 1000 / 1000).cast("decimal(12,6)")), F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return found.withColumn("models_used", F.array_join("models_used", ",")).withColumn("total_cost", F.col("total_cost").cast("double"))


def entries_by_level(spark: SparkSession, d: str) -> DataFrame:
    return compliance.entries_by_level(S.audit_entries(spark, d))


def fairness_report(spark: SparkSession, d: str) -> DataFrame:
    return compliance.fairness_report(S.audit_entries(spark, d))


def audit_rbac_view(spark: SparkSession, d: str) -> DataFrame:
    return compliance.visible_entries(S.audit_entries(spark, d), viewer="user-7", role="manager", department="error").select("id", "user_id", "department")


def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Chains of each department are built, one response of some is altered, and the links are verified."""
    path = scratch(spark, "chains")
    compliance.build_chains(S.audit_entries(spark, d), chain="department").write.parquet(path)  # a log is at rest when it is verified
    built = spark.read.parquet(path)
    altered = F.when(F.col("id") % 4000 == 1234, F.sha2(F.lit("altered"), 256)).otherwise(F.col("response_hash"))
    return compliance.verify_chains(built.withColumn("response_hash", altered), chain="department")


def document_lineage(spark: SparkSession, d: str) -> DataFrame:
    return compliance.document_versions(S.table(spark, d, "documents")).filter("version > 1")


def routing_costs(spark: SparkSession, d: str) -> DataFrame:
    """One scenario for each nation: its customers as daily queries."""
    own = S.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scenario")).agg((F.count("*") * 100).alias("queries"))
    return finops.routing_costs(own.select("scenario", "queries", F.lit(0.7).alias("simple"), F.lit(0.2).alias("medium"), F.lit(0.1).alias("complex")))


QUERIES = {f.__name__: f for f in (audit_discrepancies, audit_report, cost_by_agent, cost_by_user, cost_summary_period, drift_alerts, drift_worst, prompt_cache_hits, cache_friendliness, compliance_summary, compliance_report, entries_by_level, fairness_report, audit_rbac_view, chain_verify, document_lineage, routing_costs)}

_DRIFT = f"WITH {TRACES}, w AS (SELECT model, date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS week, round(avg(latency_ms) / 20, 6) AS latency, round(avg(cache_hit::INT), 6) AS cache FROM t GROUP BY 1, 2), m AS (SELECT model, week, 'latency' AS metric, latency AS score FROM w UNION ALL SELECT model, week, 'cache', cache FROM w), j AS (SELECT b.model, b.metric, c.week, b.score AS baseline, c.score AS current, round(c.score - b.score, 9) AS delta FROM m b JOIN m c ON b.model = c.model AND b.metric = c.metric AND b.week = 0 AND c.week > 0) SELECT *, CASE WHEN -delta >= 0.05 THEN 'RED' ELSE 'YELLOW' END AS severity FROM j WHERE -delta >= 0.02"
_BIAS = "SELECT \"group\", n, round(n / sum(n) OVER (), 6) AS share, CASE WHEN sum(n) OVER () < 30 THEN 'insufficient' WHEN n / sum(n) OVER () > 2.0 / count(*) OVER () THEN 'biased' ELSE 'clean' END AS result, 2.0 / count(*) OVER () < 1 AS max_possible, '{check}' AS \"check\" FROM (SELECT coalesce({key}, 'unknown') AS \"group\", count(*) AS n FROM a {where} GROUP BY 1)"

ORACLES = {
    "audit_discrepancies": f"WITH {LINES} SELECT invoice_id, line_item_index, cargo_type, rate4 / 10000.0::DOUBLE AS expected_rate, price4 / 10000.0::DOUBLE AS actual_rate, abs(diff4) / 10000.0::DOUBLE AS difference, percentage, {BANDS}[o + 1] AS band FROM b",
    "audit_report": f"WITH {LINES}, p AS (SELECT invoice_id, count(*) AS n, CAST((sum(abs(diff4)) + 50) // 100 AS BIGINT) AS cents, max(o) AS o FROM b GROUP BY 1) SELECT o_orderkey AS invoice_id, coalesce(n, 0) AS n_discrepancies, coalesce(cents, 0) / 100.0::DOUBLE AS total_discrepancy, {BANDS}[coalesce(o, 0) + 1] AS max_band, coalesce(o, 0) > 0 AS needs_approval, 'Invoice ' || o_orderkey || ' from customer ' || o_custkey || ': ' || CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' discrepancy' ELSE ' discrepancies' END || ' found totaling EUR ' || CAST(CAST(cents AS DECIMAL(24,2)) / 100 AS DECIMAL(24,2)) || '. Maximum severity: ' || {BANDS}[o + 1] || '.' ELSE 'no discrepancies found. All rates match contract.' END AS summary FROM orders LEFT JOIN p ON invoice_id = o_orderkey",
    "cost_by_agent": f"WITH {TRACES} SELECT agent_name, sum(u)::DOUBLE / 1e8 AS total_cost, count(*) AS queries FROM cost WHERE agent_name <> '' GROUP BY 1",
    "cost_by_user": f"WITH {TRACES} SELECT user_id, sum(u)::DOUBLE / 1e8 AS total_cost, count(*) AS queries FROM cost WHERE user_id IS NOT NULL GROUP BY 1",
    "cost_summary_period": f"WITH {TRACES} SELECT sum(u)::DOUBLE / 1e8 AS total_cost, count(*) AS total_queries, round(sum(u)::DOUBLE / 1e8 / count(*), 8) AS avg_cost, round(avg(cache_hit::INT), 8) AS cache_hit_rate, (SELECT string_agg(agent_name || '=' || x, ',' ORDER BY agent_name) FROM (SELECT agent_name, (sum(u)::DECIMAL(26,8) / 100000000)::DECIMAL(18,8)::VARCHAR AS x FROM cost WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1)) AS by_agent FROM cost WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "drift_alerts": _DRIFT,
    "drift_worst": f"SELECT model, CASE WHEN bool_or(severity = 'RED') THEN 'RED' ELSE 'YELLOW' END AS severity, count(*) AS n FROM ({_DRIFT}) GROUP BY 1",
    "prompt_cache_hits": f"WITH {TRACES}, p AS (SELECT concat_ws('|', user_id, agent_name) AS x FROM t) SELECT count(*) AS total_prompts, count(*) - count(DISTINCT x) AS hits, count(DISTINCT x) AS misses, round((count(*) - count(DISTINCT x)) / count(*), 6) AS hit_rate FROM p",
    "cache_friendliness": "WITH s AS (SELECT conv_id AS prompt_id, turn AS position, min(CASE role WHEN 'system' THEN 'STATIC' WHEN 'assistant' THEN 'SESSION_STABLE' ELSE 'DYNAMIC' END) AS kind, min(text) AS content FROM conversations GROUP BY 1, 2), f AS (SELECT *, length(coalesce(content, '')) // 4 AS t, min(CASE WHEN kind = 'DYNAMIC' THEN position END) OVER (PARTITION BY prompt_id) AS fd FROM s), g AS (SELECT prompt_id, sum(t) AS total, coalesce(sum(t) FILTER (kind = 'STATIC'), 0) AS st, coalesce(sum(t) FILTER (kind <> 'DYNAMIC'), 0) AS ca, coalesce(sum(t) FILTER (fd IS NULL OR position < fd), 0) AS pre FROM f GROUP BY 1) SELECT prompt_id, round(CASE WHEN total > 0 THEN st / total ELSE 0 END, 6) AS static_ratio, round(CASE WHEN total > 0 THEN ca / total ELSE 0 END, 6) AS cacheable_ratio, round(CASE WHEN total > 0 AND ca > 0 THEN (ca / total) * (pre / ca) ELSE 0 END, 6) AS score FROM g",
    "compliance_summary": f"WITH {ENTRIES} SELECT count(*) AS total_entries, count(*) FILTER (is_degraded) AS degraded_count, count(DISTINCT model_version) AS distinct_models, count(DISTINCT user_id) AS distinct_users FROM a",
    "compliance_report": f"WITH {ENTRIES} SELECT count(*) AS total_entries, string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS models_used, count(DISTINCT user_id) AS unique_users, count(hitl_approver_id) AS hitl_approvals, sum(id % 1000)::BIGINT / 1000.0::DOUBLE AS total_cost, count(*) FILTER (is_degraded) AS degraded_count, count(*) FILTER (log_level = 'full_trace') AS full_trace, count(*) FILTER (log_level = 'summary') AS summary, count(*) FILTER (log_level = 'metadata_only') AS metadata_only, 'sha256:' || sha256(count(*) || ':2024-01-05T00:00:00+00:00:2024-01-20T00:00:00+00:00') AS entry_count_hash FROM a WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "entries_by_level": f"WITH {ENTRIES} SELECT log_level, count(*) AS n FROM a GROUP BY 1",
    "fairness_report": f"WITH {ENTRIES} " + " UNION ALL ".join(_BIAS.format(check=c, key=k, where=w) for c, k, w in (("routing", "department", ""), ("model_preference", "model_version", ""), ("degraded", "department", "WHERE is_degraded"))),
    "audit_rbac_view": f"WITH {ENTRIES} SELECT id, user_id, department FROM a WHERE user_id = 'user-7' OR department = 'error'",
    "chain_verify": f"WITH {ENTRIES}, r AS (SELECT department, id, row_number() OVER (PARTITION BY department ORDER BY created_at, id) - 1 AS i FROM a) SELECT department, min(i) FILTER (id % 4000 = 1234) IS NULL AS valid, min(i) FILTER (id % 4000 = 1234) AS broken_at, count(*) AS n FROM r GROUP BY 1",
    "document_lineage": "WITH v AS (SELECT doc_id, sha256(coalesce(text, '')) AS source_hash, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS document_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS version FROM documents) SELECT document_id, version, source_hash, doc_id FROM v WHERE version > 1",
    "routing_costs": "WITH s AS (SELECT c_nationkey AS scenario, count(*) * 100 AS q FROM customer GROUP BY 1), r AS (SELECT *, q * (0.0::DOUBLE + 0.7::DOUBLE * 0.0004::DOUBLE + 0.2::DOUBLE * 0.003::DOUBLE + 0.1::DOUBLE * 0.014::DOUBLE) + q * 0.000025::DOUBLE AS routed, q * 0.014::DOUBLE AS unrouted FROM s) SELECT scenario, round(routed, 4) AS routed_daily, round(unrouted, 4) AS unrouted_daily, round((unrouted - routed) / unrouted * 100, 1) AS savings_pct, round(q * 0.1::DOUBLE * 0.05::DOUBLE, 1) AS misclassified FROM r",
}
