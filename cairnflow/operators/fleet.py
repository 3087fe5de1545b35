"""Fleet map: states, headings, grid cells and text search; and the provider breaker's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("alert", "cold_chain", "stopped", "idle", "moving")


def truck_states(latest: DataFrame, anomalies: DataFrame, refrigerated: DataFrame) -> DataFrame:
    """Adds ``state`` by priority; the other tables name trucks (truck_id)."""
    flag = lambda df, name: df.select("truck_id").distinct().withColumn(name, F.lit(True))
    rows = latest.join(flag(anomalies, "_a"), "truck_id", "left").join(flag(refrigerated, "_r"), "truck_id", "left")
    still = F.col("speed_kmh") == 0
    state = F.when(F.col("_a"), STATES[0]).when(F.col("_r"), STATES[1]).when(still & ~F.col("engine_on"), STATES[2]).when(still, STATES[3]).otherwise(STATES[4])
    return rows.withColumn("state", state).drop("_a", "_r")


def state_counts(states: DataFrame) -> DataFrame:
    """A row for each state, 0 where no truck has it."""
    wide = states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return wide.select(F.explode(F.create_map(*(x for s in STATES for x in (F.lit(s), F.col(s))))).alias("state", "n"))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north between two positions, equirectangular."""
    east = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)) + 360.0, F.lit(360.0))


def headings(pings: DataFrame, *, least: float = 0.0001) -> DataFrame:
    """Adds ``heading``: the bearing from the last accepted position to the one that moved on from it; 0 at first.

    A position is accepted when it lies over ``least`` degrees from the last accepted one, so
    small steps add up until they count. A task walks the sorted pings of its trucks with
    one position each in hand.
    """
    import math
    from collections.abc import Iterator

    import pyarrow as pa

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lat, lng, now = None, None, None, 0.0
        for batch in batches:
            out = []
            for truck, y, x in zip(*(batch.column(c).to_pylist() for c in ("truck_id", "latitude", "longitude")), strict=True):
                if truck != own or lat is None:
                    own, lat, lng, now = truck, y, x, 0.0
                elif y is not None and x is not None and (abs(y - lat) > least or abs(x - lng) > least):
                    east = (x - lng) * math.cos(math.radians((lat + y) / 2))
                    now = (math.degrees(math.atan2(east, y - lat)) + 360.0) % 360.0
                    lat, lng = y, x
                out.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "heading"])

    rows = pings.repartition("truck_id").sortWithinPartitions("truck_id", "ts", "seq")
    return rows.mapInArrow(walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pings.schema) + ", heading double")


def compass(degrees: Column) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.floor(degrees / 45 + 0.5) % 8 + 1).cast("int"))


def deviation_class(temp: Column, setpoint: Column) -> Column:
    off = F.abs(temp - setpoint)
    return F.when(off <= 1, "ok").when(off <= 3, "warning").otherwise("critical")


def relative_time(seconds: Column) -> Column:
    unit = lambda n, s: F.concat(F.floor(seconds / n).cast("string"), F.lit(s))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).otherwise(unit(3600, "h"))


def grid(pings: DataFrame, *, cell: float = 0.5, weight: Column | None = None) -> DataFrame:
    """(cell_x, cell_y, n, latitude, longitude) of map cells, the position a weighted mean."""
    w = F.lit(1.0) if weight is None else weight
    mean = lambda c: F.round(F.sum(w * F.col(c)) / F.sum(w), 6).alias(c)
    x, y = (F.floor(F.col(c) / cell).cast("long") for c in ("longitude", "latitude"))
    return pings.groupBy(x.alias("cell_x"), y.alias("cell_y")).agg(F.count("*").alias("n"), mean("latitude"), mean("longitude"))


def in_box(pings: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Positions of a box, rims included; both conditions reach the scan."""
    return pings.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def bounds(pings: DataFrame) -> DataFrame:
    return pings.agg(*(f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))))


def search(rows: DataFrame, text: str, *, columns: tuple[str, ...], states: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with the text in any of the columns, case ignored, and a state of the set."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return rows.filter(hit) if states is None else rows.filter(hit & F.col("state").isin(*states))


def interpolated(points: Column, progress: Column) -> Column:
    """The (lat, lng) at a share of the way along an array of points, evenly spaced."""
    last = F.size(points) - 1
    at = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(at), F.greatest(last - 1, F.lit(0))).cast("int")
    a, b = F.get(points, i), F.coalesce(F.get(points, i + 1), F.get(points, i))
    mix = lambda k: a[k] + (b[k] - a[k]) * (at - i)
    return F.struct(mix("lat").alias("lat"), mix("lng").alias("lng"))


def breaker_states(calls: DataFrame, *, failures: int = 5, reset_seconds: float = 60.0, successes: int = 3) -> DataFrame:
    """(provider, state, trips, rejected, failed, succeeded) after all calls (provider, ts, seq, ok) in order.

    A task walks the sorted calls of its providers with one small state each, whatever
    their number.
    """
    from collections.abc import Iterator

    import pandas as pd

    schema = "provider string, state string, trips long, rejected long, failed long, succeeded long"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, s = None, {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([{"provider": own} | {k: s[k] for k in ("state", "trips", "rejected", "failed", "succeeded")}])

        for frame in frames:
            for provider, at, ok in zip(frame["provider"], frame["at"], frame["ok"], strict=True):
                if provider != own:
                    if s:
                        yield out()
                    own, s = provider, {"state": "closed", "trips": 0, "rejected": 0, "failed": 0, "succeeded": 0, "run": 0, "since": 0}
                if s["state"] == "open":
                    if at - s["since"] < reset_seconds * 1e6:
                        s["rejected"] += 1
                        continue
                    s["state"], s["run"] = "half_open", 0
                if ok:
                    s["succeeded"] += 1
                    s["run"] = s["run"] + 1 if s["state"] == "half_open" else 0
                    if s["state"] == "half_open" and s["run"] >= successes:
                        s["state"], s["run"] = "closed", 0
                else:
                    s["failed"] += 1
                    s["run"] = failures if s["state"] == "half_open" else s["run"] + 1
                    if s["run"] >= failures:
                        s["state"], s["since"], s["run"] = "open", at, 0
                        s["trips"] += 1
        if s:
            yield out()

    rows = calls.select("provider", F.unix_micros("ts").alias("at"), "seq", "ok").repartition("provider").sortWithinPartitions("provider", "at", "seq")
    return rows.mapInPandas(walk, schema)


def retry_delay(attempt: Column, *, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before a retry, doubling up to a limit, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def jittered_delay(attempt: Column, draw: Column, *, base: float = 1.0, most: float = 30.0) -> Column:
    """Full jitter: a share, ``draw`` from 0 to 1, of the delay without it."""
    return retry_delay(attempt, base=base, most=most) * draw


def near_waypoint(progress: Column, waypoint: Column, points: Column, *, band: float = 0.15) -> Column:
    """Whether a trip's progress lies within the band around a waypoint's share of the way."""
    return F.abs(progress - waypoint / F.greatest(points - 1, F.lit(1))) <= band


def anomaly_progress(progress: Column, waypoint: Column, points: Column, *, band: float = 0.15) -> Column:
    """From 0 at the start of the band around a waypoint to 1 at its end."""
    start = waypoint / F.greatest(points - 1, F.lit(1)) - band
    return F.least(F.greatest((progress - start) / (2 * band), F.lit(0.0)), F.lit(1.0))


def even_points(points: Column, n: int) -> Column:
    """``n`` evenly spaced elements of an array with both ends; all of a shorter one."""
    step = (F.size(points) - 1) / F.lit(float(max(1, n - 1)))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(points, F.round(i * step).cast("int")))
    return F.when(F.size(points) <= n, points).otherwise(picked)


def truck_shard(truck: Column, shards: int) -> Column:
    """The number at the end of a truck's id modulo the shards; 0 without one."""
    return F.pmod(F.coalesce(F.regexp_extract(truck, r"(\d+)$", 1).try_cast("long"), F.lit(0)), F.lit(shards)).cast("int")


def route_label(route: Column) -> Column:
    """``milan-berlin`` as ``Milan → Berlin``."""
    return F.array_join(F.transform(F.split(route, "-"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))), " → ")


def message_rate(rows: DataFrame) -> DataFrame:
    """One row: messages and messages a second over the time that they span, a second at least."""
    span = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    return rows.agg(F.count("*").alias("n"), F.round(F.count("*") / F.greatest(F.coalesce(span, F.lit(0.0)), F.lit(1.0)), 6).alias("per_second"))


def active_anomalies(trucks: DataFrame, *, column: str = "anomaly") -> DataFrame:
    return trucks.filter(F.col(column).isNotNull())


def alert_histogram(alerts: DataFrame) -> DataFrame:
    """(alert_type, severity, n) for the map's side panel."""
    return alerts.groupBy("alert_type", "severity").agg(F.count("*").alias("n"))


def shown_rows(rows: DataFrame, n: int = 20, *, by: str = "ts", tie: str = "seq") -> DataFrame:
    """The newest n rows for display: an ordered limit, which Spark takes in every partition first."""
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n)


#: Kilometres of a degree of latitude.
DEGREE_KM = 111.195


def route_distance(latitude: Column, longitude: Column, points: Column) -> Column:
    """Kilometres from a position to the nearest place on a line through an array of (lat, lng), on a plane at the position's latitude; null without points."""
    wide = F.cos(F.radians(latitude)) * DEGREE_KM
    flat = F.transform(points, lambda p: F.struct(((p["lng"] - longitude) * wide).alias("x"), ((p["lat"] - latitude) * DEGREE_KM).alias("y")))
    ends = F.concat(F.slice(flat, 2, F.greatest(F.size(flat), F.lit(1))), F.slice(flat, -1, 1))  # the last point is a stretch of its own

    def near(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = dx * dx + dy * dy
        share = F.when(long > 0, F.least(F.greatest(-(a["x"] * dx + a["y"] * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(a["x"] + share * dx, a["y"] + share * dy)

    return F.when(F.size(points) > 0, F.array_min(F.zip_with(flat, ends, near)))


def route_deviations(pings: DataFrame, routes: DataFrame, *, most_km: float = 5.0) -> DataFrame:
    """(truck_id, seq, ts, distance_km) of positions over ``most_km`` off their truck's route (truck_id, points); trucks without one are left out."""
    far = route_distance(F.col("latitude"), F.col("longitude"), F.col("points"))
    return pings.join(routes.select("truck_id", "points"), "truck_id").withColumn("distance_km", far).filter(F.col("distance_km") > most_km).select("truck_id", "seq", "ts", "distance_km")


def silences(pings: DataFrame, *, minutes: float = 15.0) -> DataFrame:
    """(truck_id, last_at, silent_at): each time that a truck sent nothing for so long, though it had before and did afterwards; equal times are one."""
    order = Window.partitionBy("truck_id").orderBy("ts")
    gap = F.unix_micros(F.lead("ts").over(order)) - F.unix_micros("ts")
    quiet = F.lit(int(minutes * 60e6))
    return pings.select("truck_id", "ts").distinct().withColumn("_gap", gap).filter(F.col("_gap") > quiet).select("truck_id", F.col("ts").alias("last_at"), F.timestamp_micros(F.unix_micros("ts") + quiet).alias("silent_at"))
