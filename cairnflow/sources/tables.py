"""Readers for the tables of a data folder, and the engine's records derived from them.

Each adapter is a projection over one or two Parquet scans, so filters and column
selections on its output still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; zone-less timestamps are taken as UTC instants, which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.select(*(F.col(c).cast("timestamp").alias(c) if c in naive else c for c in df.columns)) if naive else df


def prop_k() -> Column:
    """The number k of an event's properties, 0 where there is none."""
    return F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))


def model_name(k: Column) -> Column:
    return F.when(k % 3 == 0, "gpt-5-nano").when(k % 3 == 1, "gpt-5-mini").otherwise("gpt-5.2")


def temperature_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truck_id, sensor_id, temp_celsius, setpoint_celsius, ts, seq) from events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("truck_id"),
        F.concat(F.lit("s-"), "event_type").alias("sensor_id"),
        F.col("value").alias("temp_celsius"),
        F.lit(50.0).alias("setpoint_celsius"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def gps_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truck_id, latitude, longitude, speed_kmh, engine_on, ts, seq) from events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("truck_id"),
        (F.lit(47.0) + (F.col("event_id") % 1000) / 250.0).alias("latitude"),
        (F.lit(8.0) + (F.col("event_id") % 700) / 100.0).alias("longitude"),
        F.col("value").alias("speed_kmh"),
        (F.col("event_type") != "signup").alias("engine_on"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls from events: (trace_id, agent_name, model, prompt_tokens, completion_tokens, latency_ms, cache_hit, user_id, ts)."""
    k = prop_k()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trace_id"),
        F.col("event_type").alias("agent_name"),
        model_name(k).alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"),
        k.cast("long").alias("completion_tokens"),
        F.col("value").alias("latency_ms"),
        (k % 7 == 0).alias("cache_hit"),
        F.when(k % 11 != 0, F.col("user_id")).alias("user_id"),
        "ts",
    )


def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit-log entries from events; response and query text stand for the logged strings."""
    k = prop_k()
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_type").alias("department"),
        model_name(k).alias("model_version"),
        F.concat(F.lit("query "), F.col("props")).alias("query_text"),
        F.concat(F.lit("response "), F.col("event_id").cast("string")).alias("response_text"),
        F.when(k % 5 == 0, "full_trace").when(k % 5 < 3, "summary").otherwise("metadata_only").alias("log_level"),
        F.when(k % 4 == 0, F.concat(F.lit("approver-"), (k % 3).cast("string"))).alias("hitl_approver_id"),
        (k % 10 == 0).alias("is_degraded"),
        F.concat(F.lit("provider-"), (k % 3).cast("string")).alias("provider_name"),
        (k % 13 == 0).alias("quality_drift_alert"),
    )


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice line items from lineitem, prices as decimal(12,4)."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    units = F.col("l_quantity").cast("long")
    price = F.expr("(CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT)) DIV (2 * CAST(l_quantity AS BIGINT))")  # half up, in ten-thousandths
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_item_index"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").alias("cargo_type"),
        units.cast("decimal(12,4)").alias("quantity"),
        (price / 10000).cast("decimal(12,4)").alias("unit_price"),
        (cents / 100).cast("decimal(12,2)").alias("total"),
        F.lit("EUR").alias("currency"),
    )


def contract_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreed rates per cargo type from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cargo_type"),
        F.col("p_retailprice").cast("decimal(12,4)").alias("rate"),
        F.lit("EUR").alias("currency"),
    )


def secured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a department and a clearance level from 1 to 4."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        F.col("source").alias("department_id"),
        (F.col("doc_id") % 4 + 1).cast("int").alias("clearance_level"),
    )
