"""Queries that run a stream, a writer or a reader over the given tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, compliance, finops, quality, retrieval, telemetry
from ..session import scratch
from ..sources import files
from ..sources import tables as S
from ..streaming import telemetry as stream
from . import knowledge, signals
from .business import ENTRIES, TRACES
from .signals import THROTTLE, WIDE

#: A key of the vault, as a test has one; a cluster's comes from its own store of secrets.
VAULT_KEY = "0123456789abcdef"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of a topic: readings, every 50th also as one that can't be read and every 70th under a topic that nobody knows."""
    readings = S.temperature_readings(spark, d)
    good = stream.messages(readings).select(F.lit(stream.TOPICS[0]).alias("topic"), "value")
    bad = readings.filter("seq % 50 = 0").select(F.lit(stream.TOPICS[0]).alias("topic"), F.concat(F.lit("{no json "), "seq").alias("value"))
    other = readings.filter("seq % 70 = 0").select(F.lit("fleet.unknown").alias("topic"), F.concat(F.lit("m"), "seq").alias("value"))
    return good.unionByName(bad).unionByName(other)


def _arrived(spark: SparkSession, d: str, name: str) -> Iterator[DataFrame]:
    """The messages in three batches by time: the same stream, each time that a batch has come whole, in as many files as it has partitions.

    A run of a query on it, with one checkpoint for all, takes what has come as one batch.
    """
    path = scratch(spark, name)
    rows = S.temperature_readings(spark, d)
    marks = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.3, 0.7], 1000).alias("m")).first().m or [0, 0]
    batch = F.when(F.unix_micros("ts") < marks[0], 0).when(F.unix_micros("ts") < marks[1], 1).otherwise(2)
    for k in range(3):
        own = stream.messages(rows.filter(batch == k)).select(F.lit(stream.TOPICS[0]).alias("topic"), "value")
        own.write.mode("append").parquet(path)
        yield spark.readStream.schema("topic string, value string").parquet(path)


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The temperature rules on a stream of messages, in three batches, give what the batch form gives."""
    out, state = scratch(spark, "stream-alerts"), scratch(spark, "stream-alerts-state")
    for raw in _arrived(spark, d, "messages"):
        rows, _ = stream.parsed(stream.topic(raw, stream.TOPICS[0]))
        minutes = WIDE["window_minutes"]
        found = stream.temperature_alerts(rows, margin=WIDE["margin"], window_minutes=minutes, throttle_seconds=THROTTLE, lateness="30 days", idle="300 days")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.ALERT).parquet(out).select("truck_id", "alert_type", "severity", "seq", "check_order")


def stream_health(spark: SparkSession, d: str) -> DataFrame:
    """Messages, those without a truck and the newest time, as the stream's own metrics tell."""
    told, state = [], scratch(spark, "health-state")
    for raw in _arrived(spark, d, "health"):
        rows, _ = stream.parsed(raw)
        query = stream.with_health(rows).writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        told.append(stream.health(query))
    newest = max((t["last_message_at"] for t in told if t["last_message_at"] is not None), default=None)
    return spark.createDataFrame([(sum(t["processed"] for t in told), sum(t["errors"] for t in told))], "processed long, errors long").withColumn("last_message", F.date_format(F.lit(newest).cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))


def stream_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 alerts, as a sink of batches keeps them."""
    path, state = scratch(spark, "newest-alerts"), scratch(spark, "newest-state")
    for raw in _arrived(spark, d, "newest"):
        rows, _ = stream.parsed(raw)
        alerts = rows.filter(F.abs(F.col("temp_celsius") - 50) > 50).select("truck_id", F.lit("temperature_spike").alias("alert_type"), F.lit("critical").alias("severity"), "ts", "seq", F.lit(0).alias("check_order"))
        query = stream.write_batches(alerts, stream.newest_alerts(spark, path), state)
        query.processAllAvailable()
        query.stop()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return spark.read.parquet(f"{path}/{max(int(n) for n in names if n.isdigit())}").select("truck_id", "seq")


def message_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Messages that can't be read, and those of topics that nobody takes."""
    raw = _messages(spark, d)
    _, rejects = stream.parsed(stream.topic(raw, stream.TOPICS[0]))
    return rejects.select(F.lit("unread").alias("reason"), "message").unionByName(stream.unknown_topics(raw).select(F.lit("unknown topic").alias("reason"), "message"))


def _batch_alerts(spark: SparkSession, d: str) -> DataFrame:
    return S.temperature_readings(spark, d).filter("abs(temp_celsius - 50) > 50").select("truck_id", F.lit("spike").alias("alert_type"), "ts", "seq")


def alert_windows(spark: SparkSession, d: str) -> DataFrame:
    """Alerts in windows of a day, and in those of two days that begin each day."""
    alerts = _batch_alerts(spark, d)
    own = lambda name, rows: rows.select(F.lit(name).alias("kind"), F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n")
    return own("tumbling", stream.alert_counts(alerts, window="1 day")).unionByName(own("sliding", stream.alert_counts(alerts, window="2 days", slide="1 day")))


def alert_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = stream.alert_sessions(_batch_alerts(spark, d), gap="1 day")
    return found.select("truck_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def ingested_records(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of each truck's last reading, sent by itself, against its history."""
    rows = S.temperature_readings(spark, d)
    last = rows.groupBy("truck_id").agg(F.max_by("seq", F.struct("ts", "seq")).alias("seq"))
    record = rows.join(last, ["truck_id", "seq"], "left_semi")
    history = rows.join(last, ["truck_id", "seq"], "left_anti")
    return stream.ingest(record, history, **WIDE).select("truck_id", "alert_type", "severity", "seq", "check_order")


def vault_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the audit log through the vault: sealed, some deleted, the rest read again."""
    entries = S.audit_entries(spark, d).withColumnRenamed("id", "audit_entry_id")
    key = F.lit(VAULT_KEY).cast("binary")
    vault = compliance.vault_store(entries, key, key_id="k1")
    path = scratch(spark, "vault")
    compliance.vault_delete(vault, entries.filter("audit_entry_id % 6 = 0"), F.lit("2024-02-01").cast("timestamp")).write.parquet(path)
    stored = spark.read.parquet(path)
    return compliance.vault_read(stored, key).join(stored.select("audit_entry_id", F.date_format("retention_until", "yyyy-MM-dd").alias("retention")), "audit_entry_id")


def judge_report(spark: SparkSession, d: str) -> DataFrame:
    """The rates of biased judges beside their calibration, and whether all keep their limits."""
    return quality.bias_report(knowledge.judge_bias_rates(spark, d), knowledge.spearman_calibration(spark, d))


def recent_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs of the periods that end at the end of January."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    priced = finops.with_cost(S.traces(spark, d), finops.pricing_table(spark))
    parts = [finops.in_period(priced, finops.period_start(p, now), now).agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("cost")).select(F.lit(p).alias("period"), "n", "cost") for p in ("24h", "7d", "30d")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unpriced_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of each model by a price list that lacks one, whose calls cost nothing."""
    prices = finops.pricing_table(spark).filter("model <> 'gpt-5.2'")
    priced = finops.with_cost(S.traces(spark, d), prices, unknown="zero")
    return priced.groupBy("model").agg(F.count("*").alias("n"), F.sum("cost").cast("double").alias("cost"))


def user_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that one user of a table of users may see; reports are only for those who may see them."""
    compliance.may_report("compliance_officer")
    users = S.table(spark, d, "nation").select(F.concat(F.lit("user-"), "n_nationkey").alias("user_id"), F.array(F.concat(F.lit("src"), F.col("n_nationkey") % 20)).alias("departments"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("clearance"))
    own = retrieval.resolve_user(users, "user-6")
    return retrieval.visible(S.secured_documents(spark, d), departments=own["departments"], clearance=own["clearance"]).select("doc_id")


def legacy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose overlap is never under one word."""
    return chunking.chunked(S.table(spark, d, "documents"), overlap=0, least_overlap=1).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha256"))


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Made-up answers of classifiers and routers, read."""
    n = F.col("event_id")
    tier = F.when(n % 4 == 0, F.concat(F.lit(" simple 0."), (n % 90 + 10).cast("string"))).when(n % 4 == 1, "MEDIUM").when(n % 4 == 2, "complex 7").otherwise("perhaps 0.5")
    kind = F.when(n % 3 == 0, '{"category": "Vague", "confidence": 0.75}').when(n % 3 == 1, '{"category": "poem"}').otherwise("none")
    lines = F.concat(F.lit("\n first \r\n\n"), n.cast("string"), F.lit("\n third"))
    e = S.table(spark, d, "events").select(n, X.classification(tier).alias("c"), X.query_category(kind).alias("q"), X.answer_lines(lines, 2).alias("l"))
    return e.select("event_id", "c.tier", F.round("c.confidence", 6).alias("sure"), "q.category", F.round("q.confidence", 6).alias("category_sure"), F.array_join("l", "|").alias("lines"))


def read_back(spark: SparkSession, d: str) -> DataFrame:
    """Nations through a folder of texts, one of a JSON array, rows that are appended and a write with a marker."""
    nation = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    texts, arrays, log, both = (scratch(spark, f"files-{x}") for x in ("texts", "arrays", "log", "both"))
    nation.repartition(25, "k").select("n_name").write.text(texts)
    read = files.read_texts(spark, texts, ["/", "file:"]).select(F.lit("text").alias("how"), F.explode(F.split("text", "\n")).alias("name")).filter("name <> ''")
    nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("k", "n_name")))).alias("value")).write.text(arrays)  # a table of 25 rows
    array = files.read_json_array(spark, arrays, "k long, n_name string").select(F.lit("json").alias("how"), F.col("n_name").alias("name"))
    kept = files.append_returning(nation, log, now=F.lit("2024-01-01").cast("timestamp")).filter("id IS NOT NULL AND created_at IS NOT NULL").select(F.lit("append").alias("how"), F.col("n_name").alias("name"))
    for part in (nation.filter("k < 5"), nation):
        files.write_with_marker({"rows": part, "state": part.limit(1)}, both)
    nation.limit(2).write.parquet(f"{both}/unfinished/rows")
    marked = files.last_written(spark, both, "rows").select(F.lit("marker").alias("how"), F.col("n_name").alias("name"))
    return read.unionByName(array).unionByName(kept).unionByName(marked)


QUERIES = {f.__name__: f for f in (stream_alerts, stream_health, stream_newest, message_rejects, alert_windows, alert_sessions, ingested_records, vault_texts, judge_report, recent_costs, unpriced_costs, user_documents, legacy_chunks, parsed_answers, read_back)}

_SPIKES = "a AS (SELECT user_id::VARCHAR AS truck_id, ts, event_id AS seq FROM events WHERE abs(value - 50) > 50)"

ORACLES = {
    "stream_alerts": signals.ORACLES["temperature_alerts"],
    "stream_health": "SELECT count(*) AS processed, 0 AS errors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_message FROM events",
    "stream_newest": f"WITH {_SPIKES} SELECT truck_id, seq FROM a ORDER BY ts DESC, seq DESC LIMIT 50",
    "message_rejects": "SELECT 'unread' AS reason, '{no json ' || event_id AS message FROM events WHERE event_id % 50 = 0 UNION ALL SELECT 'unknown topic', 'm' || event_id FROM events WHERE event_id % 70 = 0",
    "alert_windows": f"WITH {_SPIKES} SELECT 'tumbling' AS kind, strftime(ts, '%Y-%m-%d') AS start, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'sliding', strftime(ts - b * INTERVAL 1 DAY, '%Y-%m-%d'), count(*) FROM a, range(2) t(b) GROUP BY ALL",
    "alert_sessions": f"WITH {_SPIKES}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 DAY, true)::INT AS fresh FROM a WINDOW w AS (PARTITION BY truck_id ORDER BY ts, seq)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY truck_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT truck_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY truck_id, k",
    "ingested_records": f"SELECT * FROM ({signals.ORACLES['temperature_alerts'].replace(str(THROTTLE), '300')}) WHERE seq IN (SELECT arg_max(event_id, (ts, event_id)) FROM events GROUP BY user_id)",
    "vault_texts": f"WITH {ENTRIES} SELECT id AS audit_entry_id, query_text, strftime(created_at + INTERVAL 10 YEAR, '%Y-%m-%d') AS retention FROM a WHERE id % 6 <> 0",
    "judge_report": f"SELECT b.*, correlation, calibrated, position_bias <= 0.1 AND verbosity_bias <= 0.15 AND self_preference <= 0.1 AND calibrated AS trusted FROM ({knowledge.ORACLES['judge_bias_rates']}) b, ({knowledge.ORACLES['spearman_calibration']})",
    "recent_costs": f"WITH {TRACES} SELECT period, count(u) AS n, sum(u)::DOUBLE / 1e8 AS cost FROM (VALUES ('24h', TIMESTAMP '2024-01-30'), ('7d', TIMESTAMP '2024-01-24'), ('30d', TIMESTAMP '2024-01-01')) p(period, start) LEFT JOIN cost ON ts BETWEEN start AND TIMESTAMP '2024-01-31' GROUP BY 1",
    "unpriced_costs": f"WITH {TRACES} SELECT model, count(*) AS n, sum(CASE WHEN model = 'gpt-5.2' THEN 0 ELSE u END)::DOUBLE / 1e8 AS cost FROM cost GROUP BY 1",
    "user_documents": "SELECT doc_id FROM documents WHERE source = 'src6' AND doc_id % 4 + 1 <= 3",
    "legacy_chunks": knowledge.ORACLES["chunk_fixed"].replace("c.l - c.f - 10", "c.l - c.f - 1"),
    "parsed_answers": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'MEDIUM' ELSE 'COMPLEX' END AS tier, CASE event_id % 4 WHEN 0 THEN (event_id % 90 + 10) / 100.0::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS sure, CASE event_id % 3 WHEN 0 THEN 'vague' ELSE 'standard' END AS category, CASE event_id % 3 WHEN 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS category_sure, 'first|' || event_id AS lines FROM events",
    "read_back": "SELECT how, n_name AS name FROM nation, (SELECT unnest(['text', 'json', 'append', 'marker']) AS how)",
}
