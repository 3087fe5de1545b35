"""Cold-chain and speed rules over telemetry, in batch form.

Histories are window frames of bounded length, so a truck's readings stream through one
sort and are never collected. The throttle walks the sorted alerts of a key with one time
in hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 120
CHECK_ORDER = {"threshold": 0, "drift": 1, "zscore": 2}


def _ordered(key: str = "truck_id"):
    return Window.partitionBy(key).orderBy("ts", "seq")


def threshold_breaches(readings: DataFrame, *, margin: float = 5.0) -> DataFrame:
    """Readings strictly outside setpoint ± margin, with the deviation. A null value is no breach."""
    deviation = F.col("temp_celsius") - F.col("setpoint_celsius")
    return readings.withColumn("deviation", deviation).filter(F.abs("deviation") > margin)


def with_drift(readings: DataFrame, *, window_minutes: float = 30.0, min_minutes: float = 5.0) -> DataFrame:
    """Adds elapsed_minutes and drift, the change per 30 minutes since the first reading of the window.

    The window also ends at the last ``HISTORY`` readings. Drift is null below
    ``min_minutes`` or with a single reading.
    """
    seconds = int(window_minutes * 60)
    timed = readings.withColumn("_sec", F.unix_micros("ts"))
    back = Window.partitionBy("truck_id").orderBy("_sec").rangeBetween(-seconds * 1_000_000, 0)
    rows = _ordered().rowsBetween(-(HISTORY - 1), 0)
    entry = F.struct("_sec", "seq", "temp_celsius")
    first = F.greatest(F.min(entry).over(back), F.first(entry).over(rows))
    elapsed = (F.col("_sec") - F.col("_first._sec")) / 60e6
    change = F.col("temp_celsius") - F.col("_first.temp_celsius")
    out = timed.withColumn("_first", first).withColumn("elapsed_minutes", elapsed)
    drift = F.when(F.col("elapsed_minutes") >= min_minutes, change * 30.0 / F.col("elapsed_minutes"))
    return out.withColumn("drift", drift).drop("_sec", "_first")


def drifts(readings: DataFrame, *, rate: float = 2.0, window_minutes: float = 30.0, min_minutes: float = 5.0) -> DataFrame:
    found = with_drift(readings, window_minutes=window_minutes, min_minutes=min_minutes).filter(F.abs("drift") > rate)
    return found.withColumn("direction", F.when(F.col("drift") > 0, "rising").otherwise("falling"))


def with_zscore(readings: DataFrame, *, min_rows: int = 5) -> DataFrame:
    """Adds zscore against the earlier rows of the history; null with too few rows or no spread."""
    past = _ordered().rowsBetween(-(HISTORY - 1), -1)
    mean, std, n = (f("temp_celsius").over(past) for f in (F.avg, F.stddev_pop, F.count))
    out = readings.withColumn("_mean", mean).withColumn("_std", std).withColumn("_n", n)
    z = F.when((F.col("_n") >= min_rows - 1) & (F.col("_std") > 0), (F.col("temp_celsius") - F.col("_mean")) / F.col("_std"))
    return out.withColumn("zscore", z).drop("_mean", "_std", "_n")


def zscores(readings: DataFrame, *, threshold: float = 5.0) -> DataFrame:
    return with_zscore(readings).filter(F.abs("zscore") > threshold)


def temperature_candidates(readings: DataFrame, *, margin: float = 5.0, rate: float = 2.0, threshold: float = 5.0, window_minutes: float = 30.0, min_minutes: float = 5.0) -> DataFrame:
    """A row for each rule that a reading breaks, before throttling: (truck_id, alert_type, severity, details, ts, seq, check_order).

    Both windows share one sort of the readings by truck and time.
    """
    facts = with_zscore(with_drift(readings, window_minutes=window_minutes, min_minutes=min_minutes))
    deviation = F.col("temp_celsius") - F.col("setpoint_celsius")

    def alert(hit: Column, kind: str, severity: str, details: Column, check: str) -> Column:
        row = F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), details.alias("details"), F.lit(CHECK_ORDER[check]).alias("check_order"))
        return F.when(hit, row)

    found = F.array(
        alert(F.abs(deviation) > margin, "temperature_spike", "critical", F.format_string("%.1f C is %.1f C from the setpoint", "temp_celsius", F.abs(deviation)), "threshold"),
        alert(F.abs("drift") > rate, "temperature_drift", "high", F.format_string("%s by %.1f C in 30 min", F.when(F.col("drift") > 0, "rising").otherwise("falling"), F.abs("drift")), "drift"),
        alert(F.abs("zscore") > threshold, "temperature_spike", "high", F.format_string("z-score %.1f", "zscore"), "zscore"),
    )
    return facts.select("truck_id", "ts", "seq", F.explode(F.array_compact(found)).alias("a")).select("truck_id", "a.alert_type", "a.severity", "a.details", "ts", "seq", "a.check_order")


def speed_candidates(pings: DataFrame, *, max_speed: float = 120.0) -> DataFrame:
    """Over the limit (high), or standing with the engine on (medium)."""
    over = F.col("speed_kmh") > max_speed
    idle = (F.col("speed_kmh") == 0) & F.coalesce("engine_on", F.lit(True))
    severity = F.when(over, "high").when(idle, "medium")
    details = F.when(over, F.format_string("%.1f km/h is over the limit", "speed_kmh")).otherwise("stopped with the engine on")
    out = pings.select("truck_id", F.lit("speed_anomaly").alias("alert_type"), severity.alias("severity"), details.alias("details"), "ts", "seq", F.lit(0).alias("check_order"))
    return out.filter("severity IS NOT NULL")


def throttle(candidates: DataFrame, *, window_seconds: int = 300) -> DataFrame:
    """Drop alerts less than ``window_seconds`` after the last *fired* one of their (truck, type).

    Suppressed alerts do not extend the window. A task walks the sorted alerts of its keys
    with the time of the last fired one, whatever their number.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    if window_seconds <= 0:
        return candidates
    key, micros = ["truck_id", "alert_type"], window_seconds * 1_000_000
    names = candidates.columns
    rest = [c for c in names if c not in (*key, "ts", "seq", "check_order")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            fired = []
            for *now, at in zip(*(batch.column(c).to_pylist() for c in (*key, "_at")), strict=True):
                if now != own:
                    own, last = now, None
                fires = at is None or last is None or at - last >= micros
                fired.append(fires)
                last = at if fires and at is not None else last
            yield batch.select(names).filter(pa.array(fired, pa.bool_()))

    rows = candidates.withColumn("_at", F.unix_micros("ts")).repartition(*key).sortWithinPartitions(*key, "_at", "seq", "check_order", *rest)
    return rows.mapInArrow(walk, candidates.schema)


def with_staleness(rows: DataFrame, now: Column, *, seconds: int = 30) -> DataFrame:
    """Tags rows that were processed more than ``seconds`` after their event time."""
    return rows.withColumn("stale", F.unix_micros(now) - F.unix_micros("ts") > seconds * 1_000_000)


def first_alerts(alerts: DataFrame) -> DataFrame:
    """The first alert of each reading by check order; it drives the response."""
    order = Window.partitionBy("truck_id", "seq").orderBy("check_order")
    return alerts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def latest_state(rows: DataFrame, key: str = "truck_id") -> DataFrame:
    """The newest row of each key: an aggregate that combines before its shuffle, so hot keys do no harm."""
    rest = [c for c in rows.columns if c not in (key, "ts", "seq")]
    newest = rows.groupBy(key).agg(F.max(F.struct("ts", "seq", *rest)).alias("r"))
    return newest.select(key, "r.*").select(*rows.columns)


def auto_resolved(alerts: DataFrame, now: Column, *, seconds: int = 600) -> DataFrame:
    """Alerts with ``resolved`` set for those strictly older than ``seconds``."""
    old = F.unix_micros(now) - F.unix_micros("ts") > seconds * 1_000_000
    return alerts.withColumn("resolved", F.coalesce("resolved", F.lit(False)) | old if "resolved" in alerts.columns else old)


def alerts_for(alerts: DataFrame, *, truck_id: str | None = None, severity: str | None = None) -> DataFrame:
    if truck_id is not None:
        alerts = alerts.filter(F.col("truck_id") == truck_id)
    return alerts if severity is None else alerts.filter(F.col("severity") == severity)


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``alerts`` with those named in ``resolutions`` (alert_id) marked as resolved; the base table is not rewritten."""
    done = resolutions.select("alert_id").distinct().withColumn("_done", F.lit(True))
    return alerts.join(done, "alert_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)) | F.coalesce("_done", F.lit(False))).drop("_done")


def fleet_status(rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: distinct trucks and unresolved alerts."""
    trucks = rows.agg(F.countDistinct("truck_id").alias("trucks"))
    return trucks.join(alerts.agg(F.count_if(~F.col("resolved")).alias("active_alerts")))


def newest_history(alerts: DataFrame, now: Column, *, most: int = 100, ttl_days: int = 30) -> DataFrame:
    """The newest ``most`` alerts of each truck, newest first; a truck's list lives while its newest alert is within the days."""
    order = Window.partitionBy("truck_id").orderBy(F.col("ts").desc(), F.col("seq").desc(), "check_order")
    ranked = alerts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    newest = alerts.groupBy("truck_id").agg(F.max("ts").alias("_newest"))
    alive = newest.filter(F.unix_micros(now) - F.unix_micros("_newest") <= ttl_days * 86_400_000_000)
    return ranked.join(alive.select("truck_id"), "truck_id", "left_semi")


def recurring(history: DataFrame, *, threshold: int = 3) -> DataFrame:
    """Alerts of each truck and type, with a flag from ``threshold`` on."""
    return history.groupBy("truck_id", "alert_type").agg(F.count("*").alias("n")).withColumn("recurring", F.col("n") >= threshold)


def filter_rate(readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: readings seen, those without any alert, and their share (0 without readings)."""
    hit = alerts.select("truck_id", "seq").distinct().withColumn("_hit", F.lit(1))
    both = readings.select("truck_id", "seq").join(hit, ["truck_id", "seq"], "left")
    counts = both.agg(F.count("*").alias("processed"), F.count("_hit").alias("anomalies"))
    kept = F.col("processed") - F.col("anomalies")
    return counts.withColumn("filtered", kept).withColumn("filter_rate", F.when(F.col("processed") > 0, kept / F.col("processed")).otherwise(0.0))


def memories(trucks: DataFrame, recent: DataFrame | None, stored: DataFrame | None) -> DataFrame:
    """(truck_id, recent, stored): alerts of each truck in the short and the long memory; a memory that can't be read (None) is an empty one."""
    out = trucks.select("truck_id").distinct()
    for name, tier in (("recent", recent), ("stored", stored)):
        if tier is None:
            out = out.withColumn(name, F.lit(0).cast("long"))
        else:
            out = out.join(tier.groupBy("truck_id").agg(F.count("*").alias(name)), "truck_id", "left").fillna(0, [name])
    return out


def respond(alerts: DataFrame, history: DataFrame, manifests: DataFrame, *, similar: int = 2, risk: float = 0.15) -> DataFrame:
    """Fleet response: a truck with ``similar`` or more past alerts of the type is escalated, others are investigated.

    Adds similar_alerts, action and financial_risk: ``risk`` times the alert's own cargo
    value, else the manifest's. A missing history or manifest is an empty one.
    """
    past = history.groupBy("truck_id", "alert_type").agg(F.count("*").alias("similar_alerts"))
    cargo = manifests.groupBy("truck_id").agg(F.max("cargo_value_eur").alias("_cargo"))
    own = F.col("cargo_value_eur") if "cargo_value_eur" in alerts.columns else F.lit(None).cast("double")
    out = alerts.join(past, ["truck_id", "alert_type"], "left").join(cargo, "truck_id", "left").fillna(0, ["similar_alerts"])
    action = F.when(F.col("similar_alerts") >= similar, "escalate_maintenance").otherwise("investigate")
    return out.withColumn("action", action).withColumn("financial_risk", F.round(F.coalesce(own, F.col("_cargo"), F.lit(0.0)) * risk, 2)).drop("_cargo")


def notifications(responses: DataFrame) -> DataFrame:
    """Two rows for each response: one to the driver, one to dispatch."""
    text = lambda who: F.concat_ws(" ", F.lit(who), F.col("truck_id"), F.col("alert_type"), F.col("action"))
    both = F.array(*(F.struct(F.lit(r).alias("recipient"), text(f"[{r}]").alias("message")) for r in ("driver", "dispatch")))
    return responses.select("truck_id", "alert_type", "ts", "seq", F.explode(both).alias("n")).select("truck_id", "alert_type", "ts", "seq", "n.recipient", "n.message")
