"""Queries on telemetry and the fleet map, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleet, telemetry
from ..sources import tables as S

#: The events are about seven hours apart for each truck, so windows are wider than the defaults.
WIDE = {"margin": 50.0, "window_minutes": 1440.0}
THROTTLE = 21600
R = "r AS (SELECT CAST(user_id AS VARCHAR) AS truck_id, value AS v, ts, event_id AS seq, event_type FROM events)"
Z = "z AS (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS s, count(v) OVER p AS n FROM r WINDOW p AS (PARTITION BY truck_id ORDER BY ts, seq ROWS BETWEEN 119 PRECEDING AND 1 PRECEDING))"
D = "d AS (SELECT *, greatest(min(struct_pack(ts := ts, seq := seq, v := v)) OVER (PARTITION BY truck_id ORDER BY ts RANGE BETWEEN INTERVAL 1440 MINUTES PRECEDING AND CURRENT ROW), first_value(struct_pack(ts := ts, seq := seq, v := v)) OVER (PARTITION BY truck_id ORDER BY ts, seq ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)) AS f FROM r), dr AS (SELECT *, (epoch_us(ts) - epoch_us(f.ts)) / 60e6 AS el FROM d), drift AS (SELECT *, CASE WHEN el >= 5 THEN (v - f.v) * 30.0::DOUBLE / el END AS drift FROM dr)"
FIRED = "WITH RECURSIVE {r}, {src}, o AS (SELECT truck_id, row_number() OVER (PARTITION BY truck_id ORDER BY ts, seq) AS i, ts, seq FROM c), k AS (SELECT truck_id, i, ts, seq FROM o WHERE i = 1 UNION ALL SELECT n.* FROM k, LATERAL (SELECT o.truck_id, o.i, o.ts, o.seq FROM o WHERE o.truck_id = k.truck_id AND epoch_us(o.ts) - epoch_us(k.ts) >= {w}000000 AND o.i > k.i ORDER BY o.i LIMIT 1) n) SELECT truck_id, seq FROM k"


def temp_threshold(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.threshold_breaches(S.temperature_readings(spark, d), margin=50.0).select("truck_id", "seq", F.round("deviation", 6).alias("deviation"))


def temp_drift(spark: SparkSession, d: str) -> DataFrame:
    found = telemetry.drifts(S.temperature_readings(spark, d), window_minutes=1440.0)
    return found.select("truck_id", "seq", F.round("drift", 6).alias("drift"), "direction")


def temp_zscore(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.zscores(S.temperature_readings(spark, d), threshold=3.0).select("truck_id", "seq", F.round("zscore", 6).alias("zscore"))


def temperature_alerts(spark: SparkSession, d: str) -> DataFrame:
    """All temperature rules, throttled together."""
    return telemetry.throttle(telemetry.temperature_candidates(S.temperature_readings(spark, d), **WIDE), window_seconds=THROTTLE).select("truck_id", "alert_type", "severity", "seq", "check_order")


def alerts_throttled(spark: SparkSession, d: str) -> DataFrame:
    found = telemetry.throttle(telemetry.speed_candidates(S.gps_pings(spark, d), max_speed=40.0), window_seconds=THROTTLE)
    return found.select("truck_id", "seq")


def speed_rules(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.speed_candidates(S.gps_pings(spark, d)).select("truck_id", "seq", "severity")


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.latest_state(S.gps_pings(spark, d)).select("truck_id", "seq", "speed_kmh", "engine_on")


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.speed_candidates(S.gps_pings(spark, d), max_speed=100.0)


def recurring_alerts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.recurring(_alerts(spark, d))


def newest_alerts(spark: SparkSession, d: str) -> DataFrame:
    found = telemetry.newest_history(_alerts(spark, d), F.lit("2024-02-01").cast("timestamp"), most=5)
    return found.select("truck_id", "seq", "position")


def filter_rate(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.filter_rate(S.gps_pings(spark, d), _alerts(spark, d)).withColumn("filter_rate", F.round("filter_rate", 6))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    pings = S.gps_pings(spark, d)
    cold = pings.filter(F.col("truck_id").cast("int") % 5 == 0)
    return fleet.state_counts(fleet.truck_states(telemetry.latest_state(pings), _alerts(spark, d).filter("seq % 7 = 0"), cold))


def geo_grid(spark: SparkSession, d: str) -> DataFrame:
    return fleet.grid(S.gps_pings(spark, d), cell=0.5)


def heading(spark: SparkSession, d: str) -> DataFrame:
    """Positions half a degree apart count, so that several steps often add up to one."""
    out = fleet.headings(S.gps_pings(spark, d), least=0.5)
    return out.select("truck_id", "seq", F.round("heading", 3).alias("heading"))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    """A breaker for each truck over its events; errors fail."""
    calls = S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("provider"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return fleet.breaker_states(calls, failures=2, reset_seconds=36000.0, successes=2)


QUERIES = {f.__name__: f for f in (temp_threshold, temp_drift, temp_zscore, temperature_alerts, alerts_throttled, speed_rules, latest_state, recurring_alerts, newest_alerts, filter_rate, status_counts, geo_grid, heading, breaker_states)}

_SPEED = "al AS (SELECT truck_id, ts, seq, CASE WHEN v > 100 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE v > 100 OR (v = 0 AND event_type <> 'signup'))"

ORACLES = {
    "temp_threshold": f"WITH {R} SELECT truck_id, seq, round(v - 50, 6) AS deviation FROM r WHERE abs(v - 50) > 50",
    "temp_drift": f"WITH {R}, {D} SELECT truck_id, seq, round(drift, 6) AS drift, CASE WHEN drift > 0 THEN 'rising' ELSE 'falling' END AS direction FROM drift WHERE abs(drift) > 2",
    "temp_zscore": f"WITH {R}, {Z} SELECT truck_id, seq, round((v - m) / s, 6) AS zscore FROM z WHERE n >= 4 AND s > 0 AND abs((v - m) / s) > 3",
    "alerts_throttled": FIRED.format(r=R, src="c AS (SELECT * FROM r WHERE v > 40 OR (v = 0 AND event_type <> 'signup'))", w=THROTTLE),
    "speed_rules": f"WITH {R} SELECT truck_id, seq, CASE WHEN v > 120 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE v > 120 OR (v = 0 AND event_type <> 'signup')",
    "latest_state": f"WITH {R} SELECT truck_id, seq, v AS speed_kmh, event_type <> 'signup' AS engine_on FROM r QUALIFY row_number() OVER (PARTITION BY truck_id ORDER BY ts DESC, seq DESC) = 1",
    "recurring_alerts": f"WITH {R}, {_SPEED} SELECT truck_id, 'speed_anomaly' AS alert_type, count(*) AS n, count(*) >= 3 AS recurring FROM al GROUP BY 1",
    "newest_alerts": f"WITH {R}, {_SPEED}, n AS (SELECT truck_id, seq, row_number() OVER (PARTITION BY truck_id ORDER BY ts DESC, seq DESC) AS position, max(ts) OVER (PARTITION BY truck_id) AS newest FROM al) SELECT truck_id, seq, position FROM n WHERE position <= 5 AND TIMESTAMP '2024-02-01' - newest <= INTERVAL 30 DAYS",
    "filter_rate": f"WITH {R}, {_SPEED} SELECT count(*) AS processed, count(al.seq) AS anomalies, count(*) - count(al.seq) AS filtered, round((count(*) - count(al.seq)) / count(*), 6) AS filter_rate FROM r LEFT JOIN al USING (truck_id, seq)",
    "status_counts": f"WITH {R}, {_SPEED}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY truck_id ORDER BY ts DESC, seq DESC) = 1), s AS (SELECT CASE WHEN truck_id IN (SELECT truck_id FROM al WHERE seq % 7 = 0) THEN 'alert' WHEN CAST(truck_id AS INT) % 5 = 0 THEN 'cold_chain' WHEN v = 0 AND event_type = 'signup' THEN 'stopped' WHEN v = 0 THEN 'idle' ELSE 'moving' END AS state FROM l) SELECT n.state, count(s.state) AS n FROM (SELECT unnest(['alert', 'cold_chain', 'stopped', 'idle', 'moving']) AS state) n LEFT JOIN s USING (state) GROUP BY 1",
    "geo_grid": "WITH p AS (SELECT 47.0::DOUBLE + (event_id % 1000) / 250.0::DOUBLE AS latitude, 8.0::DOUBLE + (event_id % 700) / 100.0::DOUBLE AS longitude FROM events) SELECT CAST(floor(longitude / 0.5) AS BIGINT) AS cell_x, CAST(floor(latitude / 0.5) AS BIGINT) AS cell_y, count(*) AS n, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM p GROUP BY 1, 2",
    "heading": "WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS truck_id, event_id AS seq, 47.0::DOUBLE + (event_id % 1000) / 250.0::DOUBLE AS y, 8.0::DOUBLE + (event_id % 700) / 100.0::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), h AS (SELECT truck_id, seq, i, y, x, 0.0::DOUBLE AS heading FROM p WHERE i = 1 UNION ALL SELECT p.truck_id, p.seq, p.i, CASE WHEN m THEN p.y ELSE h.y END, CASE WHEN m THEN p.x ELSE h.x END, CASE WHEN m THEN fmod(degrees(atan2((p.x - h.x) * cos(radians((h.y + p.y) / 2)), p.y - h.y)) + 360.0, 360.0) ELSE h.heading END FROM h JOIN p ON p.truck_id = h.truck_id AND p.i = h.i + 1, LATERAL (SELECT abs(p.y - h.y) > 0.5 OR abs(p.x - h.x) > 0.5 AS m) k) SELECT truck_id, seq, round(heading, 3) AS heading FROM h",
    "temperature_alerts": f"WITH RECURSIVE {R}, {Z}, {D}, c AS (SELECT truck_id, ts, seq, 'temperature_spike' AS alert_type, 'critical' AS severity, 0 AS check_order FROM r WHERE abs(v - 50) > 50 UNION ALL SELECT truck_id, ts, seq, 'temperature_drift', 'high', 1 FROM drift WHERE abs(drift) > 2 UNION ALL SELECT truck_id, ts, seq, 'temperature_spike', 'high', 2 FROM z WHERE n >= 4 AND s > 0 AND abs((v - m) / s) > 5), o AS (SELECT *, row_number() OVER (PARTITION BY truck_id, alert_type ORDER BY ts, seq, check_order) AS i FROM c), k AS (SELECT * FROM o WHERE i = 1 UNION ALL SELECT n.* FROM k, LATERAL (SELECT o.* FROM o WHERE o.truck_id = k.truck_id AND o.alert_type = k.alert_type AND o.i > k.i AND epoch_us(o.ts) - epoch_us(k.ts) >= {THROTTLE}000000 ORDER BY o.i LIMIT 1) n) SELECT truck_id, alert_type, severity, seq, check_order FROM k",
    "breaker_states": "WITH RECURSIVE p AS (SELECT CAST(user_id AS VARCHAR) AS provider, epoch_us(ts) AS u, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (SELECT DISTINCT provider, 0::BIGINT AS i, 'closed' AS state, 0::BIGINT AS trips, 0::BIGINT AS rejected, 0::BIGINT AS failed, 0::BIGINT AS succeeded, 0 AS run, 0::BIGINT AS since FROM p UNION ALL SELECT provider, i + 1, CASE WHEN rej THEN 'open' WHEN ok THEN CASE WHEN e = 'half_open' AND r1 >= 2 THEN 'closed' ELSE e END WHEN r1 >= 2 THEN 'open' ELSE e END, trips + (NOT rej AND NOT ok AND r1 >= 2)::BIGINT, rejected + rej::BIGINT, failed + (NOT rej AND NOT ok)::BIGINT, succeeded + (NOT rej AND ok)::BIGINT, CASE WHEN rej THEN run WHEN NOT ok AND r1 >= 2 OR ok AND e = 'half_open' AND r1 >= 2 THEN 0 ELSE r1 END, CASE WHEN NOT rej AND NOT ok AND r1 >= 2 THEN u ELSE since END FROM (SELECT *, CASE WHEN ok THEN CASE WHEN e = 'half_open' THEN r0 + 1 ELSE 0 END ELSE CASE WHEN e = 'half_open' THEN 2 ELSE r0 + 1 END END AS r1 FROM (SELECT b.*, p.u, p.ok, b.state = 'open' AND p.u - b.since < 36000000000 AS rej, CASE WHEN b.state = 'open' THEN 'half_open' ELSE b.state END AS e, CASE WHEN b.state = 'open' THEN 0 ELSE b.run END AS r0 FROM b JOIN p ON p.provider = b.provider AND p.i = b.i + 1))) SELECT provider, state, trips, rejected, failed, succeeded FROM b QUALIFY row_number() OVER (PARTITION BY provider ORDER BY i DESC) = 1",
}
