"""Queries on lineage, alerts, caches, contracts and the fleet's small rules, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, compliance, finops, fleet, quality, retrieval, telemetry
from ..sources import files
from ..sources import tables as S
from .business import ENTRIES, TRACES
from .knowledge import TOKENS
from .signals import D, R, Z

NOW = "2024-01-15 12:00:00"
USERS = [("u1", ["src0", "src1"], 2), ("u2", ["src1", "src5", "src1"], 4), ("u3", ["none"], 4)]


def _now():
    return F.lit(NOW).cast("timestamp")


def _speed(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.speed_candidates(S.gps_pings(spark, d), max_speed=100.0)


# ---- audit log, lineage and contracts


def chain_build(spark: SparkSession, d: str) -> DataFrame:
    """The hash chain of each department."""
    return compliance.build_chains(S.audit_entries(spark, d), chain="department").select("id", "department", "prev_entry_hash", "entry_hash")


def chain_ends(spark: SparkSession, d: str) -> DataFrame:
    return compliance.last_entries(compliance.build_chains(S.audit_entries(spark, d), chain="department"), chain="department")


def source_hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each document: right for even ids, of another hash or version for others."""
    versions = compliance.document_versions(S.table(spark, d, "documents"))
    wrong = F.when(F.col("doc_id") % 3 == 0, F.lit("sha256 of nothing")).otherwise(F.col("source_hash"))
    claims = versions.select("document_id", (F.col("version") + F.when(F.col("doc_id") % 5 == 0, 1000).otherwise(0)).alias("version"), wrong.alias("expected_hash"))
    return compliance.verified_sources(claims, versions)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return compliance.document_versions(S.table(spark, d, "documents")).withColumnRenamed("doc_id", "version_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return docs.select("version_id", "chunk_index", F.sha2("line", 256).alias("content_hash"))


def lineage_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as chunks beside their document's version."""
    return compliance.lineage(_versions(spark, d), _lines(spark, d)).select("document_id", "version", "chunk_index", "content_hash")


def full_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and a hash of each document's versions and chunks in order."""
    found = compliance.full_lineage(_versions(spark, d), _lines(spark, d))
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return found.select("document_id", joined("versions", "version_id").alias("version_ids"), F.size("chunks").cast("long").alias("chunks"), F.sha2(joined("chunks", "content_hash"), 256).alias("chunks_sha256"))


def trace_snapshots(spark: SparkSession, d: str) -> DataFrame:
    e, k = S.table(spark, d, "events"), S.prop_k()
    usage = F.struct(F.when(k % 3 != 0, k).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    body = F.struct(usage.alias("usage"), F.when(k % 4 != 0, F.round("value", 2)).alias("cost"), F.when(k % 5 != 0, S.model_name(k)).alias("model"), F.when(k % 6 != 0, F.col("event_type")).alias("output"))
    found = compliance.snapshots(e.select(F.col("event_id").alias("trace_id"), F.to_json(body).alias("payload")))
    return found.withColumn("total_cost_eur", F.col("total_cost_eur").cast("double"))


def snapshot_verify(spark: SparkSession, d: str) -> DataFrame:
    """Audit entries against traces that differ in some models and tokens."""
    t = S.traces(spark, d).select("trace_id", F.col("model").alias("model_version"), "prompt_tokens", F.col("completion_tokens"))
    entries = t.withColumn("model_version", F.when(F.col("trace_id") % 7 == 0, None).otherwise(F.col("model_version"))).withColumn("prompt_tokens", F.col("prompt_tokens") + F.when(F.col("trace_id") % 11 == 0, 1).otherwise(0))
    found = compliance.snapshot_mismatches(entries, t, fields=("model_version", "prompt_tokens", "completion_tokens"))
    return found.withColumn("mismatches", F.array_join("mismatches", ","))


def metadata_bias(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the number kept in the events' JSON metadata."""
    rows = S.table(spark, d, "events").select((compliance.metadata_field(F.col("props"), "k").cast("int") % 40).alias("department"))
    return compliance.proportion_bias(compliance.group_counts(rows, "department"), times=1.1)


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("user_id").alias("prompt_tokens")).alias("usage")))).otherwise(F.to_json(F.struct(F.col("user_id").alias("prompt_eval_count"), F.col("event_id").alias("eval_count"))))
    return e.select("event_id", X.token_usage(body).alias("u")).select("event_id", "u.*")


def retention_dates(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "orders").select("o_orderkey", compliance.retention_date(F.col("o_orderdate").cast("date")).alias("until"))


def entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    return compliance.entry(S.audit_entries(spark, d), 42).select("id", "user_id", "model_version")


def invoice_lines_joined(spark: SparkSession, d: str) -> DataFrame:
    """Lines of some suppliers beside all orders, which keep a line of zeros without them."""
    lines = S.invoice_lines(spark, d).filter("supplier % 3 = 0").select("invoice_id", "quantity", "total")
    headers = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    return audit.invoices_with_lines(headers, lines).select("invoice_id", F.col("quantity").cast("double"), F.col("total").cast("double"))


def approvals(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")
    reports = o.select(F.col("o_orderkey").alias("invoice_id"), F.when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("done").alias("status"))
    decisions = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("invoice_id"), F.when(F.col("o_custkey") % 2 == 0, "approved").otherwise("rejected").alias("decision"))
    return audit.transition(reports, decisions)


# ---- finops and judges


def provider_stats(spark: SparkSession, d: str) -> DataFrame:
    e, k = S.table(spark, d, "events"), S.prop_k()
    return finops.chain_stats(e.select(S.model_name(k).alias("provider"), (k % 4 == 0).alias("is_fallback"), (k % 8 == 0).alias("from_cache")))


def reconciled_traces(spark: SparkSession, d: str) -> DataFrame:
    """Two stores that share a third of the traces."""
    t = S.traces(spark, d).select("trace_id", "model", "latency_ms")
    return finops.reconciled(t.filter("trace_id % 3 <> 0"), t.filter("trace_id % 3 <> 1"))


def model_versions(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("event_type").alias("model"), (F.floor(F.col("user_id") / 50)).cast("string").alias("version"), "ts", F.col("event_id").alias("seq"))
    return finops.version_changes(e).select("model", "seq", "previous_version", "changed")


def current_versions(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events").select(F.col("event_type").alias("model"), (F.floor(F.col("user_id") / 50)).cast("string").alias("version"), "ts", F.col("event_id").alias("seq"))
    return finops.current_versions(e)


def prompt_order(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a conversation's prompt, static ones first."""
    kind = F.when(F.col("role") == "system", "STATIC").when(F.col("role") == "assistant", "SESSION_STABLE").otherwise("DYNAMIC")
    rows = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("position")).agg(F.min(kind).alias("section_type"))
    return finops.restructured(rows).select("prompt_id", "position", "new_position")


def prompt_savings(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    saved = finops.daily_savings(F.col("c_custkey"), F.lit(800), F.lit(0.5), F.lit(0.25), F.lit(0.002))
    return c.select("c_custkey", F.round(saved, 6).alias("saved"))


def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of the order priorities as a classifier's answers, by the texts of their statuses."""
    o = S.table(spark, d, "orders")
    said = F.concat_ws(" ", F.when(F.col("o_orderkey") % 4 == 0, " simple").when(F.col("o_orderkey") % 4 == 1, "MEDIUM").when(F.col("o_orderkey") % 4 == 2, "complex").otherwise("unsure"), F.when(F.col("o_custkey") % 3 == 0, "0.9").when(F.col("o_custkey") % 3 == 1, "0.5"))
    text = F.when(F.col("o_custkey") % 10 == 0, "an Invoice is late").otherwise("hello")
    return quality.tier_counts(o.select(X.routed_tier(text, said).alias("tier")))


def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are long enough, texts that need a lawyer, and those with a number near 50."""
    c = S.table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.acceptable_response(F.col("text"), min_length=60).alias("acceptable"), X.needs_legal_context(F.concat("text", F.when(F.col("conv_id") % 3 == 0, F.lit(" see ANNEX 2")).otherwise(F.lit("")))).alias("legal"), X.has_number(F.concat("text", F.lit(" "), F.col("conv_id").cast("string")), F.lit(50.0), tolerance=5.0).alias("near_fifty"))


def judge_independence(spark: SparkSession, d: str) -> DataFrame:
    name = lambda n: F.element_at(F.array(*map(F.lit, ("GPT-5", "o1-mini", "claude-x", "Llama-3", "mistral-7b", "command-r", "other"))), (n % 7 + 1).cast("int"))
    o = S.table(spark, d, "orders")
    judge, model = name(F.col("o_orderkey")), name(F.col("o_custkey"))
    return o.select("o_orderkey", X.model_family(judge).alias("family"), X.independent_judge(judge, model).alias("independent"))


def outage_phases(spark: SparkSession, d: str) -> DataFrame:
    e, k = S.table(spark, d, "events"), S.prop_k()
    return quality.outage_phases(e.select(F.col("event_type").alias("phase"), ((F.col("event_type") == "error") | (k % 2 == 0)).alias("degraded")))


def category_matrix(spark: SparkSession, d: str) -> DataFrame:
    t = S.traces(spark, d).select("model", F.col("agent_name").alias("category"), F.col("cache_hit").cast("double").alias("score"), "latency_ms")
    return quality.category_matrix(t, ["gpt-5-nano", "gpt-5-mini", "gpt-5.2"], base="gpt-5-nano").withColumnsRenamed({"gpt-5.2": "gpt_5_2", "gpt-5.2_delta": "gpt_5_2_delta", "gpt-5.2_ms": "gpt_5_2_ms"})


def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = S.traces(spark, d)
    return quality.category_accuracy(t.select(F.col("model").alias("provider"), F.col("agent_name").alias("category"), F.when(F.col("user_id").isNotNull(), F.col("cache_hit")).alias("correct")))


def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    t = S.traces(spark, d).select(F.col("agent_name").alias("category"), F.when(F.col("cache_hit"), "treated").otherwise("base").alias("arm"), F.col("latency_ms").alias("value"))
    return quality.paired_comparison(t).select("category", *(F.round(c, 6).alias(c) for c in ("base", "treated", "delta", "percent")))


def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as queries, their lines as answers, and parts of their number as relevant ones."""
    q, r, w = _hits(spark, d)
    return quality.hit_rate(q, r, w, 5)


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_nationkey").alias("category"))
    scored = S.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("score"))
    relevant = S.table(spark, d, "part").filter("p_size < 20").select((F.col("p_partkey") % 100).alias("query_id"), F.col("p_partkey").alias("doc_id"))
    return q, retrieval.top_k(scored, 200), relevant


def hit_details(spark: SparkSession, d: str) -> DataFrame:
    q, r, w = _hits(spark, d)
    return quality.hit_details(q, r, w, 200)


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation whose three heuristic scores pass together, the first turn taken as context."""
    return _judged(spark, d).select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("precision", "faithfulness", "relevancy")), quality.passes_gate(*map(F.col, ("precision", "faithfulness", "relevancy")), threshold=0.3).alias("passes"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    q, c, a = (F.col(x) for x in ("question", "context", "answer"))
    return _pairs(spark, d).select("conv_id", "turn", X.context_precision(q, c, a).alias("precision"), X.faithfulness(q, c, a).alias("faithfulness"), X.answer_relevancy(q, a).alias("relevancy"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = S.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return turns.withColumnRenamed("text", "answer").join(before, ["conv_id", "turn"]).join(first, "conv_id")


def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return quality.eval_means(_pairs(spark, d))


# ---- documents and search


def corpus_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = S.secured_documents(spark, d).join(S.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return files.corpus_findings(docs, domains={"lang": ["en", "de"]})


def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    return files.corpus_profile(S.table(spark, d, "documents"), kind="lang")


def token_df_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    return retrieval.inverse_document_frequencies(retrieval.document_frequencies(docs), docs.agg(F.count("*").alias("n"))).withColumn("idf", F.round("idf", 6))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_extendedprice").alias("score"))


def dedup_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a supplier by their dearest line."""
    return retrieval.best_documents(_chunks(spark, d), 5).select("query_id", "document_id", "score", "rank")


def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Two result lists that overlap, each chunk once at its best score."""
    rows = _chunks(spark, d)
    return retrieval.merged_results([rows.filter("document_id % 3 <> 0"), rows.filter("document_id % 3 <> 1")])


def rbac_pairs(spark: SparkSession, d: str) -> DataFrame:
    users = files.dimension(spark, USERS, "user_id string, departments array<string>, clearance int")
    return retrieval.visible_to(S.secured_documents(spark, d), users).select("user_id", "doc_id")


def clearance_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = S.secured_documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("clearance_level")).alias("clearance_level"))
    return compliance.legal_findings(rows, contract_id="C-1", parent_clearance=2).select("doc_id", "clearance_level", "contract_id")


def relevance_demo(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", F.round(retrieval.demo_relevance("the from with which", F.lit(0.88), F.coalesce("text", F.lit(""))), 6).alias("relevance"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    return c.select("c_custkey", retrieval.partition_key(F.col("c_nationkey") % 4 + 1, F.array("c_mktsegment", F.lit("ALL")), F.when(F.col("c_custkey") % 2 == 0, F.array("c_name"))).alias("partition_key"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("created_at"), (F.col("user_id") * 10000).alias("ttl_seconds"), F.array("user_id", F.col("user_id") + 1).alias("source_doc_ids"))


def cache_expired(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cache_expire(_cache(spark, d), _now()).select("entry_id")


def cache_evicted(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cache_evict(_cache(spark, d), 500).select("entry_id")


def cache_invalidated(spark: SparkSession, d: str) -> DataFrame:
    gone = S.table(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("doc_id"))
    return retrieval.cache_invalidate(_cache(spark, d), gone).select("entry_id")


def stale_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose source was updated after they were cached are misses."""
    rows = S.table(spark, d, "embeddings").withColumn("partition_key", F.col("label").cast("string"))
    entries = rows.select("partition_key", F.col("vec_id").alias("entry_id"), F.lit("a").alias("response"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.array("vec_id").alias("source_doc_ids"), "embedding")
    updates = rows.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("doc_id"), F.lit("2024-01-02").cast("timestamp").alias("updated_at"))
    asks = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "partition_key", "embedding")
    return retrieval.cache_lookup(asks, entries, threshold=0.99, updates=updates).select("query_id", "entry_id")


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the documents' lines as chunks."""
    lines = S.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    found = quality.chunk_stats(lines)
    return found.select("chunks", *(F.round(c, 6).alias(c) for c in ("per_doc", "mean_size", "sd_size")), "min_size", "max_size")


# ---- telemetry and the map


def stale_readings(spark: SparkSession, d: str) -> DataFrame:
    """Event times against a fixed time of processing."""
    rows = telemetry.with_staleness(S.gps_pings(spark, d), _now(), seconds=86400)
    return rows.groupBy("stale").agg(F.count("*").alias("n"))


def first_alerts(spark: SparkSession, d: str) -> DataFrame:
    found = telemetry.first_alerts(telemetry.temperature_candidates(S.temperature_readings(spark, d), margin=40.0, window_minutes=1440.0))
    return found.select("truck_id", "seq", "alert_type", "severity", F.regexp_replace("details", "[0-9.]+", "#").alias("details"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    return _speed(spark, d).withColumn("alert_id", F.col("seq"))


def resolved_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts resolved by hand or by age."""
    done = S.table(spark, d, "events").filter("event_id % 9 = 0").select(F.col("event_id").alias("alert_id"))
    found = telemetry.resolve_alerts(telemetry.auto_resolved(_named(spark, d), F.lit("2024-01-20").cast("timestamp"), seconds=864000), done)
    return telemetry.alerts_for(found, severity="high").select("alert_id", "resolved")


def fleet_status(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.fleet_status(S.gps_pings(spark, d), telemetry.auto_resolved(_named(spark, d), F.lit("2024-01-20").cast("timestamp"), seconds=864000))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    alerts = telemetry.speed_candidates(S.gps_pings(spark, d), max_speed=120.0)
    manifests = S.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("truck_id"), F.floor("c_acctbal").alias("cargo_value_eur"))
    return telemetry.respond(alerts, _speed(spark, d), manifests)


def fleet_response(spark: SparkSession, d: str) -> DataFrame:
    """Alerts over 120 against a history of those over 100."""
    return _responses(spark, d).select("truck_id", "seq", "similar_alerts", "action", "financial_risk")


def truck_memories(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the last days as the short memory, all as the long one."""
    alerts = _speed(spark, d)
    return telemetry.memories(S.gps_pings(spark, d), alerts.filter(F.col("ts") > F.lit("2024-01-25").cast("timestamp")), alerts)


def notifications(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.notifications(_responses(spark, d)).select("truck_id", "seq", "recipient", "message")


def alert_histogram(spark: SparkSession, d: str) -> DataFrame:
    return fleet.alert_histogram(_speed(spark, d))


def active_anomalies(spark: SparkSession, d: str) -> DataFrame:
    pings = S.gps_pings(spark, d).withColumn("anomaly", F.when(F.col("speed_kmh") > 110, "speed"))
    return fleet.active_anomalies(pings).select("truck_id", "seq")


def shown_pings(spark: SparkSession, d: str) -> DataFrame:
    return fleet.shown_rows(S.gps_pings(spark, d), 20).select("truck_id", "seq")


def message_rate(spark: SparkSession, d: str) -> DataFrame:
    return fleet.message_rate(S.gps_pings(spark, d))


def map_labels(spark: SparkSession, d: str) -> DataFrame:
    """Compass, temperature class, age and shard of each event."""
    e = S.table(spark, d, "events")
    age = F.floor((F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("ts")) / 1e6 % 9000)
    return e.select("event_id", fleet.compass(F.col("value") * 3.6).alias("compass"), fleet.deviation_class(F.col("value") / 10, F.lit(4.0)).alias("deviation"), fleet.relative_time(age).alias("age"), fleet.truck_shard(F.concat(F.lit("truck-"), "user_id"), 4).alias("shard"), fleet.route_label(F.concat("event_type", F.lit("-bern"))).alias("label"))


def map_view(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the positions of a box whose trucks match a text."""
    pings = fleet.search(fleet.in_box(S.gps_pings(spark, d), 47.5, 9.0, 50.0, 13.0), "7", columns=("truck_id",))
    return fleet.bounds(pings)


def trip_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places along a fixed route by the share of the way, and the band around its second point."""
    points = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((47.0, 8.0), (48.0, 9.0), (50.0, 9.5), (52.0, 13.0))))
    share = F.col("value") / 81.7
    at = fleet.interpolated(points, share)
    e = S.table(spark, d, "events").select("event_id", at.alias("p"), fleet.near_waypoint(share, F.lit(1), F.lit(4)).alias("near"), F.round(fleet.anomaly_progress(share, F.lit(1), F.lit(4)), 6).alias("progress"))
    return e.select("event_id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"), "near", "progress")


def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part")
    return p.select("p_partkey", F.round(fleet.jittered_delay(F.col("p_size") % 8, F.col("p_partkey") % 10 / 10.0), 6).alias("delay"))


QUERIES = {
    f.__name__: f
    for f in (
        chain_build, chain_ends, source_hash_verify, lineage_join, full_lineage, trace_snapshots, snapshot_verify, metadata_bias, token_usage, retention_dates, entry_lookup, invoice_lines_joined, approvals,
        provider_stats, reconciled_traces, model_versions, current_versions, prompt_order, prompt_savings, tier_counts, text_checks, judge_independence, outage_phases, category_matrix, category_accuracy, paired_comparison, hit_rates, hit_details, quality_gate, eval_means,
        corpus_validation, corpus_profile, token_df_idf, dedup_best_chunk, merged_results, rbac_pairs, clearance_filter, relevance_demo, cache_keys, cache_expired, cache_evicted, cache_invalidated, stale_cache, line_stats,
        stale_readings, first_alerts, resolved_alerts, fleet_status, fleet_response, truck_memories, notifications, alert_histogram, active_anomalies, shown_pings, message_rate, map_labels, map_view, trip_positions, retry_delays,
    )
}

_CHAIN = f"{ENTRIES}, p AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY created_at, id) AS i, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN '' ELSE strftime(created_at, '.%f') END || '+00:00||' || user_id || '||' || sha256(query_text) || '||' || sha256(response_text) || '||' || model_version AS body FROM a), h AS (SELECT id, department, i, NULL::VARCHAR AS prev_entry_hash, 'sha256:' || sha256('||' || body) AS entry_hash FROM p WHERE i = 1 UNION ALL SELECT p.id, p.department, p.i, h.entry_hash, 'sha256:' || sha256(h.entry_hash || '||' || p.body) FROM h JOIN p ON p.department = h.department AND p.i = h.i + 1)"
_VERSIONS = "v AS (SELECT doc_id, sha256(coalesce(text, '')) AS source_hash, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS document_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS version FROM documents)"
_LINES = "l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS chunk_index FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))"
_AL = "al AS (SELECT truck_id, ts, seq, CASE WHEN v > {n} THEN 'high' ELSE 'medium' END AS severity FROM r WHERE v > {n} OR (v = 0 AND event_type <> 'signup'))"
_K = "coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0)"
_NAMES = "['GPT-5', 'o1-mini', 'claude-x', 'Llama-3', 'mistral-7b', 'command-r', 'other']"
_FAMILIES = "['OPENAI', 'OPENAI', 'ANTHROPIC', 'META', 'MISTRAL', 'COHERE', 'UNKNOWN']"
_CH = "ch AS (SELECT l_suppkey AS query_id, l_partkey AS document_id, l_linenumber AS chunk_index, l_extendedprice AS score FROM lineitem)"
_HITS = "s AS (SELECT l_suppkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), w AS (SELECT p_partkey % 100 AS query_id, p_partkey AS doc_id FROM part WHERE p_size < 20)"
_DW = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> ''))"
_OV = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1})) / greatest(len({0}), len({1})) ELSE 0 END"
_JUDGED = f"c AS (SELECT conv_id, turn, min(text) AS t FROM conversations GROUP BY 1, 2), f AS (SELECT conv_id, arg_min(t, turn) AS t FROM c GROUP BY 1), p AS (SELECT a.conv_id, a.turn, {_DW.format('q.t')} AS q, {_DW.format('f.t')} AS x, {_DW.format('a.t')} AS a, len(list_filter(regexp_split_to_array(lower(a.t), '\\s+'), lambda x: x <> '')) AS n FROM c a JOIN c q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 JOIN f ON f.conv_id = a.conv_id), o AS (SELECT *, ({_OV.format('q', 'x')} + {_OV.format('a', 'x')}) / 2 AS b, {_OV.format('q', 'a')} AS r, len(list_intersect(a, list_distinct(list_concat(x, q)))) AS g FROM p), j AS (SELECT conv_id, turn, CASE WHEN b > 0.05 THEN least(1.0::DOUBLE, b * 2.5 + 0.4) ELSE 0.15 END AS precision, CASE WHEN len(a) > 0 THEN least(1.0::DOUBLE, g / len(a) * 1.2::DOUBLE + 0.15) ELSE 0 END AS faithfulness, CASE WHEN r > 0.05 THEN least(1.0::DOUBLE, r * 2.0 + 0.5 + least(0.2::DOUBLE, n / 100.0::DOUBLE)) ELSE 0.15 END AS relevancy FROM o)"
_CACHE = "ca AS (SELECT event_id AS entry_id, ts AS created_at, user_id * 10000 AS ttl, user_id FROM events)"
_RESPONSE = f"{R}, {_AL.format(n=120)}, h AS (SELECT truck_id, count(*) AS n FROM r WHERE v > 100 OR (v = 0 AND event_type <> 'signup') GROUP BY 1), re AS (SELECT al.truck_id, al.seq, coalesce(n, 0) AS similar_alerts, CASE WHEN coalesce(n, 0) >= 2 THEN 'escalate_maintenance' ELSE 'investigate' END AS action, round(coalesce(floor(c_acctbal), 0) * 0.15::DOUBLE, 2) AS financial_risk FROM al LEFT JOIN h USING (truck_id) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON CAST(c_custkey AS VARCHAR) = al.truck_id)"

ORACLES = {
    "chain_build": f"WITH RECURSIVE {_CHAIN} SELECT id, department, prev_entry_hash, entry_hash FROM h",
    "chain_ends": f"WITH RECURSIVE {_CHAIN} SELECT department, entry_hash FROM h QUALIFY row_number() OVER (PARTITION BY department ORDER BY i DESC) = 1",
    "source_hash_verify": f"WITH {_VERSIONS}, c AS (SELECT document_id, version + CASE WHEN doc_id % 5 = 0 THEN 1000 ELSE 0 END AS version, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE source_hash END AS expected FROM v) SELECT c.document_id, c.version, coalesce(v.source_hash = c.expected, false) AS verified FROM c LEFT JOIN v USING (document_id, version)",
    "lineage_join": f"WITH {_VERSIONS}, {_LINES} SELECT document_id, version, chunk_index::INT AS chunk_index, sha256(line) AS content_hash FROM v JOIN l USING (doc_id)",
    "full_lineage": f"WITH {_VERSIONS}, {_LINES}, a AS (SELECT document_id, string_agg(doc_id, ',' ORDER BY version) AS version_ids FROM v GROUP BY 1), b AS (SELECT document_id, count(*) AS n, string_agg(sha256(line), ',' ORDER BY version, chunk_index) AS h FROM v JOIN l USING (doc_id) GROUP BY 1) SELECT document_id, version_ids, coalesce(n, 0) AS chunks, sha256(coalesce(h, '')) AS chunks_sha256 FROM a LEFT JOIN b USING (document_id)",
    "trace_snapshots": f"WITH e AS (SELECT *, {_K} AS k FROM events) SELECT event_id AS trace_id, CASE WHEN k % 3 <> 0 THEN k ELSE 0 END::BIGINT AS prompt_tokens, user_id AS completion_tokens, CASE WHEN k % 4 <> 0 THEN round(value, 2) ELSE 0 END AS total_cost_eur, CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN 'gpt-5-nano' WHEN 1 THEN 'gpt-5-mini' ELSE 'gpt-5.2' END END AS model_version, 'sha256:' || sha256(CASE WHEN k % 6 <> 0 THEN '\"' || event_type || '\"' ELSE 'null' END) AS response_hash FROM e",
    "snapshot_verify": "SELECT event_id AS trace_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AS verified, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'model_version' END, CASE WHEN event_id % 11 = 0 THEN 'prompt_tokens' END) AS mismatches FROM events",
    "metadata_bias": "WITH g AS (SELECT coalesce(CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 40 AS VARCHAR), 'unknown') AS \"group\", count(*) AS n FROM events GROUP BY 1) SELECT \"group\", n, round(n / sum(n) OVER (), 6) AS share, CASE WHEN sum(n) OVER () < 30 THEN 'insufficient' WHEN n / sum(n) OVER () > 1.1::DOUBLE / count(*) OVER () THEN 'biased' ELSE 'clean' END AS result, 1.1::DOUBLE / count(*) OVER () < 1 AS max_possible FROM g",
    "token_usage": "SELECT event_id, user_id AS prompt_tokens, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS completion_tokens FROM events",
    "retention_dates": "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 10 YEARS)::DATE AS until FROM orders",
    "entry_lookup": f"WITH {ENTRIES} SELECT id, user_id, model_version FROM a WHERE id = 42",
    "invoice_lines_joined": "WITH l AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT)::DOUBLE AS quantity, round(l_extendedprice * 100)::BIGINT / 100.0::DOUBLE AS total FROM lineitem WHERE l_suppkey % 3 = 0) SELECT o_orderkey AS invoice_id, coalesce(quantity, 0) AS quantity, coalesce(total, 0) AS total FROM orders LEFT JOIN l ON l_orderkey = o_orderkey",
    "approvals": "SELECT o_orderkey AS invoice_id, o_orderkey % 3 = 0 AND o_orderstatus = 'O' AS applied, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderkey % 3 <> 0 THEN 'awaiting_approval' WHEN o_custkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM orders",
    "provider_stats": f"WITH e AS (SELECT {_K} AS k FROM events) SELECT CASE k % 3 WHEN 0 THEN 'gpt-5-nano' WHEN 1 THEN 'gpt-5-mini' ELSE 'gpt-5.2' END AS provider, count(*) AS requests, count(*) FILTER (k % 4 = 0) AS fallbacks, count(*) FILTER (k % 8 = 0) AS cache_fallbacks FROM e GROUP BY 1",
    "reconciled_traces": f"WITH {TRACES} SELECT trace_id, model, latency_ms, trace_id % 3 = 0 AS reconciled FROM t",
    "model_versions": "WITH e AS (SELECT event_type AS model, event_id AS seq, CAST(user_id // 50 AS VARCHAR) AS version, lag(CAST(user_id // 50 AS VARCHAR)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous_version FROM events) SELECT model, seq, previous_version, coalesce(previous_version <> version, true) AS changed FROM e",
    "current_versions": "WITH e AS (SELECT event_type AS model, CAST(user_id // 50 AS VARCHAR) AS version, ts, event_id, lag(CAST(user_id // 50 AS VARCHAR)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events) SELECT model, version, ts AS since FROM e WHERE p IS NULL OR p <> version QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) = 1",
    "prompt_order": "WITH s AS (SELECT conv_id AS prompt_id, turn AS position, min(CASE role WHEN 'system' THEN 'STATIC' WHEN 'assistant' THEN 'SESSION_STABLE' ELSE 'DYNAMIC' END) AS kind FROM conversations GROUP BY 1, 2) SELECT prompt_id, position, row_number() OVER (PARTITION BY prompt_id ORDER BY CASE kind WHEN 'STATIC' THEN 1 WHEN 'SESSION_STABLE' THEN 2 ELSE 3 END, position) - 1 AS new_position FROM s",
    "prompt_savings": "SELECT c_custkey, round(c_custkey * 800 * 0.5::DOUBLE * 0.25::DOUBLE / 1000 * 0.002::DOUBLE * 0.5::DOUBLE, 6) AS saved FROM customer",
    "tier_counts": "WITH o AS (SELECT o_orderkey % 4 AS a, o_custkey % 3 AS b, o_custkey % 10 = 0 AS k FROM orders), p AS (SELECT *, CASE a WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'MEDIUM' ELSE 'COMPLEX' END AS t, CASE WHEN a = 3 THEN 0 WHEN b = 0 THEN 0.9 WHEN b = 1 THEN 0.5 ELSE 0.8 END AS c FROM o) SELECT CASE WHEN k THEN 'COMPLEX' WHEN c >= 0.7 THEN t WHEN t = 'SIMPLE' THEN 'MEDIUM' ELSE 'COMPLEX' END AS tier, count(*) AS n FROM p GROUP BY 1",
    "text_checks": "SELECT conv_id, turn, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) >= 60 AS acceptable, conv_id % 3 = 0 OR regexp_matches(text, '(?i)" + X.DELEGATION + "') AS legal, len(list_filter(regexp_extract_all(text || ' ' || conv_id, '[-+]?\\d+(?:\\.\\d+)?'), lambda x: abs(x::DOUBLE - 50) <= 5)) > 0 AS near_fifty FROM conversations",
    "judge_independence": f"WITH j AS (SELECT o_orderkey, {_FAMILIES}[o_orderkey % 7 + 1] AS a, {_FAMILIES}[o_custkey % 7 + 1] AS b FROM orders) SELECT o_orderkey, a AS family, a <> 'UNKNOWN' AND b <> 'UNKNOWN' AND a <> b AS independent FROM j",
    "outage_phases": f"WITH e AS (SELECT event_type AS phase, event_type = 'error' OR {_K} % 2 = 0 AS g FROM events) SELECT phase, count(*) AS n, count(*) FILTER (g) AS degraded, bool_and(g) AS all_degraded FROM e GROUP BY 1",
    "category_matrix": f"WITH {TRACES}, m AS (SELECT agent_name AS category, count(*) AS n, " + ", ".join(f"avg(cache_hit::INT) FILTER (model = '{m}') AS s{i}, avg(latency_ms) FILTER (model = '{m}') AS t{i}" for i, m in enumerate(("gpt-5-nano", "gpt-5-mini", "gpt-5.2"))) + ' FROM t GROUP BY ROLLUP (agent_name)) SELECT category, n, round(s0, 6) AS "gpt-5-nano", round(s1, 6) AS "gpt-5-mini", round(s2, 6) AS gpt_5_2, round(s1 - s0, 6) AS "gpt-5-mini_delta", round(s2 - s0, 6) AS gpt_5_2_delta, round(t0, 4) AS "gpt-5-nano_ms", round(t1, 4) AS "gpt-5-mini_ms", round(t2, 4) AS gpt_5_2_ms FROM m',
    "category_accuracy": f"WITH {TRACES} SELECT model AS provider, agent_name AS category, count(*) AS n, round(avg(cache_hit::INT), 6) AS accuracy FROM t WHERE user_id IS NOT NULL GROUP BY 1, 2",
    "paired_comparison": f"WITH {TRACES}, m AS (SELECT agent_name AS category, avg(latency_ms) FILTER (NOT cache_hit) AS b, avg(latency_ms) FILTER (cache_hit) AS t FROM t GROUP BY 1) SELECT category, round(b, 6) AS base, round(t, 6) AS treated, round(t - b, 6) AS delta, round(CASE WHEN b > 0 THEN (t - b) / b * 100 ELSE 0 END, 6) AS percent FROM m",
    "hit_rates": f"WITH {_HITS}, h AS (SELECT s_nationkey AS category, EXISTS (SELECT 1 FROM w WHERE w.query_id = s_suppkey) AS wants, EXISTS (SELECT 1 FROM k JOIN w USING (query_id, doc_id) WHERE k.query_id = s_suppkey AND rank <= 5) AS hit, EXISTS (SELECT 1 FROM k WHERE k.query_id = s_suppkey AND rank <= 5) AS got FROM supplier) SELECT category, count(*) AS n, round(avg((CASE WHEN wants THEN hit ELSE NOT got END)::INT), 6) AS hit_rate FROM h GROUP BY 1",
    "hit_details": f"WITH {_HITS} SELECT s_suppkey AS query_id, f.r IS NOT NULL AS hit, f.r AS hit_rank FROM supplier LEFT JOIN (SELECT query_id, min(rank) AS r FROM k JOIN w USING (query_id, doc_id) WHERE rank <= 200 GROUP BY 1) f ON f.query_id = s_suppkey",
    "quality_gate": f"WITH {_JUDGED} SELECT conv_id, turn, round(precision, 6) AS precision, round(faithfulness, 6) AS faithfulness, round(relevancy, 6) AS relevancy, precision > 0.3 AND faithfulness > 0.3 AND relevancy > 0.3 AS passes FROM j",
    "eval_means": f"WITH {_JUDGED} SELECT count(*) AS n, round(avg(precision), 6) AS precision, round(avg(faithfulness), 6) AS faithfulness, round(avg(relevancy), 6) AS relevancy, round(avg(precision), 6) > 0.8 AND round(avg(faithfulness), 6) > 0.8 AND round(avg(relevancy), 6) > 0.8 AS passes FROM j",
    "corpus_validation": "WITH x AS (SELECT *, length(text) AS n FROM documents) SELECT doc_id, 'error' AS level, 'lang is not known' AS message FROM x WHERE lang NOT IN ('en', 'de') UNION ALL SELECT doc_id, 'warning', 'text is short' FROM x WHERE n < 200 UNION ALL SELECT doc_id, 'warning', 'text is long' FROM x WHERE n > 3000 UNION ALL SELECT doc_id, 'error', c || ' is missing' FROM x, (SELECT unnest(['text', 'department_id', 'lang']) AS c) WHERE CASE c WHEN 'text' THEN text IS NULL WHEN 'lang' THEN lang IS NULL ELSE source IS NULL END UNION ALL SELECT doc_id, 'error', 'doc_id is repeated' FROM x GROUP BY 1 HAVING count(*) > 1",
    "corpus_profile": "SELECT lang, count(*) AS n, min(length(coalesce(text, '')))::INT AS min_chars, round(avg(length(coalesce(text, ''))), 4) AS mean_chars, max(length(coalesce(text, '')))::INT AS max_chars FROM documents GROUP BY ROLLUP (lang)",
    "token_df_idf": f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY 1",
    "dedup_best_chunk": f"WITH {_CH}, b AS (SELECT query_id, document_id, max(score) AS score FROM ch GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM b) WHERE rank <= 5",
    "merged_results": f"WITH {_CH} SELECT query_id, document_id, chunk_index, max(score) AS score FROM ch GROUP BY 1, 2, 3",
    "rbac_pairs": "SELECT user_id, doc_id FROM documents JOIN (VALUES ('u1', 'src0', 2), ('u1', 'src1', 2), ('u2', 'src1', 4), ('u2', 'src5', 4), ('u3', 'none', 4)) u(user_id, s, c) ON source = s WHERE doc_id % 4 + 1 <= c",
    "clearance_filter": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 4 + 1 END::INT AS clearance_level, 'C-1' AS contract_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 + 1 <= 2",
    "relevance_demo": "SELECT doc_id, round(least(0.88 + 0.02 * (contains(lower(coalesce(text, '')), 'from')::INT + contains(lower(coalesce(text, '')), 'with')::INT + contains(lower(coalesce(text, '')), 'which')::INT), 0.95)::DOUBLE, 6) AS relevance FROM documents",
    "cache_keys": "SELECT c_custkey, 'cl:' || (c_nationkey % 4 + 1) || '|dept:' || array_to_string(list_sort([c_mktsegment, 'ALL']), ',') || '|ent:' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS partition_key FROM customer",
    "cache_expired": f"WITH {_CACHE} SELECT entry_id FROM ca WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) <= ttl * 1000000",
    "cache_evicted": f"WITH {_CACHE} SELECT entry_id FROM ca ORDER BY created_at DESC, entry_id DESC LIMIT 500",
    "cache_invalidated": f"WITH {_CACHE}, g AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0) SELECT entry_id FROM ca WHERE user_id NOT IN (SELECT * FROM g) AND user_id + 1 NOT IN (SELECT * FROM g)",
    "stale_cache": "WITH x AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0) SELECT query_id, entry_id FROM (SELECT * FROM x WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) = 1) WHERE s >= 0.99 AND entry_id % 40 <> 0",
    "line_stats": f"WITH {_LINES} SELECT count(*) AS chunks, round(count(*) / count(DISTINCT doc_id), 6) AS per_doc, round(avg(length(line)), 6) AS mean_size, min(length(line))::INT AS min_size, max(length(line))::INT AS max_size, round(stddev_samp(length(line)), 6) AS sd_size FROM l",
    "stale_readings": f"SELECT epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 86400000000 AS stale, count(*) AS n FROM events GROUP BY 1",
    "first_alerts": f"WITH {R}, {Z}, {D}, c AS (SELECT truck_id, seq, 'temperature_spike' AS alert_type, 'critical' AS severity, printf('%.1f C is %.1f C from the setpoint', v, abs(v - 50)) AS details, 0 AS o FROM r WHERE abs(v - 50) > 40 UNION ALL SELECT truck_id, seq, 'temperature_drift', 'high', printf('%s by %.1f C in 30 min', CASE WHEN drift > 0 THEN 'rising' ELSE 'falling' END, abs(drift)), 1 FROM drift WHERE abs(drift) > 2 UNION ALL SELECT truck_id, seq, 'temperature_spike', 'high', printf('z-score %.1f', (v - m) / s), 2 FROM z WHERE n >= 4 AND s > 0 AND abs((v - m) / s) > 5) SELECT truck_id, seq, alert_type, severity, regexp_replace(details, '[0-9.]+', '#', 'g') AS details FROM c QUALIFY row_number() OVER (PARTITION BY truck_id, seq ORDER BY o) = 1",
    "resolved_alerts": f"WITH {R}, {_AL.format(n=100)} SELECT seq AS alert_id, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) > 864000000000 OR seq % 9 = 0 AS resolved FROM al WHERE severity = 'high'",
    "fleet_status": f"WITH {R}, {_AL.format(n=100)} SELECT (SELECT count(DISTINCT truck_id) FROM r) AS trucks, (SELECT count(*) FROM al WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 864000000000) AS active_alerts",
    "fleet_response": f"WITH {_RESPONSE} SELECT truck_id, seq, similar_alerts, action, financial_risk FROM re",
    "truck_memories": f"WITH {R}, {_AL.format(n=100)}, t AS (SELECT DISTINCT truck_id FROM r) SELECT truck_id, count(seq) FILTER (al.ts > TIMESTAMP '2024-01-25') AS recent, count(seq) AS stored FROM t LEFT JOIN al USING (truck_id) GROUP BY 1",
    "notifications": f"WITH {_RESPONSE} SELECT truck_id, seq, recipient, '[' || recipient || '] ' || truck_id || ' speed_anomaly ' || action AS message FROM re, (SELECT unnest(['driver', 'dispatch']) AS recipient)",
    "alert_histogram": f"WITH {R}, {_AL.format(n=100)} SELECT 'speed_anomaly' AS alert_type, severity, count(*) AS n FROM al GROUP BY 2",
    "active_anomalies": f"WITH {R} SELECT truck_id, seq FROM r WHERE v > 110",
    "shown_pings": f"WITH {R} SELECT truck_id, seq FROM r ORDER BY ts DESC, seq DESC LIMIT 20",
    "message_rate": "SELECT count(*) AS n, round(count(*) / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 1.0), 6) AS per_second FROM events",
    "map_labels": "WITH e AS (SELECT *, floor(((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 1e6) % 9000)::BIGINT AS age FROM events) SELECT event_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][floor(value * 3.6::DOUBLE / 45 + 0.5)::INT % 8 + 1] AS compass, CASE WHEN abs(value / 10 - 4) <= 1 THEN 'ok' WHEN abs(value / 10 - 4) <= 3 THEN 'warning' ELSE 'critical' END AS deviation, CASE WHEN age < 60 THEN age || 's' WHEN age < 3600 THEN age // 60 || 'm' ELSE age // 3600 || 'h' END AS age, (user_id % 4)::INT AS shard, upper(event_type[1]) || event_type[2:] || ' → Bern' AS label FROM e",
    "map_view": "WITH p AS (SELECT CAST(user_id AS VARCHAR) AS t, 47.0::DOUBLE + (event_id % 1000) / 250.0::DOUBLE AS latitude, 8.0::DOUBLE + (event_id % 700) / 100.0::DOUBLE AS longitude FROM events) SELECT min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude FROM p WHERE latitude BETWEEN 47.5 AND 50.0 AND longitude BETWEEN 9.0 AND 13.0 AND contains(t, '7')",
    "trip_positions": "WITH e AS (SELECT event_id, value / 81.7::DOUBLE AS s, least(greatest(value / 81.7::DOUBLE, 0.0), 1.0) * 3 AS a FROM events), i AS (SELECT *, least(floor(a), 2)::INT AS i FROM e), p AS (SELECT *, [47.0, 48.0, 50.0, 52.0]::DOUBLE[] AS y, [8.0, 9.0, 9.5, 13.0]::DOUBLE[] AS x FROM i) SELECT event_id, round(y[i + 1] + (y[i + 2] - y[i + 1]) * (a - i), 6) AS lat, round(x[i + 1] + (x[i + 2] - x[i + 1]) * (a - i), 6) AS lng, abs(s - 1.0::DOUBLE / 3) <= 0.15 AS near, round(least(greatest((s - (1.0::DOUBLE / 3 - 0.15::DOUBLE)) / (2 * 0.15::DOUBLE), 0.0), 1.0), 6) AS progress FROM p",
    "retry_delays": "SELECT p_partkey, round(least(30.0::DOUBLE, pow(2.0::DOUBLE, p_size % 8)) * (p_partkey % 10 / 10.0::DOUBLE), 6) AS delay FROM part",
}
