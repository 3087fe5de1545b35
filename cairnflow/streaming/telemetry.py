"""The telemetry rules on streams, with the same results as their batch form on events in order.

State is a truck's: its last readings and the time of its last fired alert by type.
Rows of a micro-batch are sorted by event time before they meet the state; rows later
than the watermark are dropped, and a truck that stays silent long enough loses its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import HISTORY

READING = "truck_id string, sensor_id string, temp_celsius double, setpoint_celsius double, ts timestamp, seq long"
ALERT = "truck_id string, alert_type string, severity string, ts timestamp, seq long, check_order int"
_STATE = "at array<long>, temp array<double>, seq array<long>, spike long, drift long"


def parsed(raw: DataFrame, schema: str = READING, *, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON messages as (rows, rejects); a message that cannot be read goes to the rejects with its text."""
    body = F.from_json(F.col(value).cast("string"), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = raw.withColumn("_m", body)
    bad = F.col("_m").isNull() | F.col("_m._corrupt").isNotNull() | F.col("_m.truck_id").isNull() | F.col("_m.ts").isNull()
    return read.filter(~bad).select("_m.*").drop("_corrupt"), read.filter(bad).select(F.col(value).cast("string").alias("message"))


TOPICS = ("fleet.temperature", "fleet.gps-pings")


def topic(raw: DataFrame, name: str) -> DataFrame:
    return raw.filter(F.col("topic") == name)


def unknown_topics(raw: DataFrame, known: tuple[str, ...] = TOPICS) -> DataFrame:
    """Messages that no handler takes, as rejects with their text."""
    return raw.filter(~F.coalesce(F.col("topic").isin(*known), F.lit(False))).select("topic", F.col("value").cast("string").alias("message"))


def kafka_source(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Raw messages from the latest offsets on; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "latest").load()


def messages(rows: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as (key, value) messages in JSON for a Kafka or file sink."""
    value = F.to_json(F.struct(*rows.columns)).alias("value")
    return rows.select(value) if key is None else rows.select(F.col(key).cast("string").alias("key"), value)


def temperature_alerts(readings: DataFrame, *, margin: float = 5.0, rate: float = 2.0, threshold: float = 5.0, window_minutes: float = 30.0, min_minutes: float = 5.0, throttle_seconds: int = 300, lateness: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """Threshold, drift and z-score alerts of each reading, throttled by truck and type."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    window, quiet = int(window_minutes * 60e6), throttle_seconds * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, temp, seq, *fired = state.get if state.exists else ([], [], [], -1, -1)
        at, temp, seq, last = list(at), list(temp), list(seq), {"temperature_spike": fired[0], "temperature_drift": fired[1]}
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            now = r.ts.value // 1000
            past = np.array(temp[-(HISTORY - 1) :])
            at, temp, seq = (xs[-(HISTORY - 1) :] + [x] for xs, x in ((at, now), (temp, r.temp_celsius), (seq, r.seq)))
            first = next(i for i, t in enumerate(at) if t >= now - window)
            minutes = (now - at[first]) / 60e6
            drift = (r.temp_celsius - temp[first]) * 30.0 / minutes if minutes >= min_minutes else 0.0
            spread = past.std() if len(past) >= 4 else 0.0
            score = (r.temp_celsius - past.mean()) / spread if spread > 0 else 0.0
            checks = (
                (abs(r.temp_celsius - r.setpoint_celsius) > margin, "temperature_spike", "critical"),
                (abs(drift) > rate, "temperature_drift", "high"),
                (abs(score) > threshold, "temperature_spike", "high"),
            )
            for order, (hit, kind, severity) in enumerate(checks):
                if hit and (last[kind] < 0 or quiet <= 0 or now - last[kind] >= quiet):
                    last[kind] = now
                    out.append((key[0], kind, severity, r.ts, r.seq, order))
        state.update((at, temp, seq, last["temperature_spike"], last["temperature_drift"]))
        state.setTimeoutTimestamp(max(at[-1] // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["truck_id", "alert_type", "severity", "ts", "seq", "check_order"])

    timed = readings.withWatermark("ts", lateness)
    return timed.groupBy("truck_id").applyInPandasWithState(run, ALERT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


SILENCE = "truck_id string, last_at timestamp, silent_at timestamp"


def silent_trucks(pings: DataFrame, *, minutes: float = 15.0, lateness: str = "1 minute") -> DataFrame:
    """A row each time a truck has sent nothing for so long: when its next message shows it, or when the watermark passes, whichever comes first.

    A truck's state is the time of its last message and whether its silence has been told.
    """
    quiet = int(minutes * 60e6)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        found = []
        if state.hasTimedOut:
            found.append(last)
            told = True
        else:
            for now in sorted(t.value // 1000 for t in pd.concat(list(frames))["ts"]):
                if last is not None and now - last > quiet and not told:
                    found.append(last)
                if last is None or now > last:
                    last, told = now, False
        state.update((last, told))
        if not told:
            state.setTimeoutTimestamp(max((last + quiet) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        at = lambda us: pd.to_datetime(us, unit="us", utc=True)
        yield pd.DataFrame([(key[0], at(t), at(t + quiet)) for t in found], columns=["truck_id", "last_at", "silent_at"])

    timed = pings.select("truck_id", "ts").withWatermark("ts", lateness)
    return timed.groupBy("truck_id").applyInPandasWithState(run, SILENCE, "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def alert_counts(alerts: DataFrame, *, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Alerts by type in tumbling or sliding windows of event time."""
    timed = alerts.withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "alert_type").agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **options: str) -> StreamingQuery:
    """A query that hands each micro-batch to ``write``; a replayed batch comes with the same number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()


def alert_sessions(alerts: DataFrame, *, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Runs of a truck's alerts of one type without a gap."""
    return alerts.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "truck_id", "alert_type").agg(F.count("*").alias("n"))


def with_health(rows: DataFrame, name: str = "health") -> DataFrame:
    """Counts rows, those without a truck, and the newest event time as the batch's metrics, which a listener or ``lastProgress`` shows."""
    return rows.observe(name, F.count("*").alias("processed"), F.count_if(F.col("truck_id").isNull()).alias("errors"), F.max("ts").alias("last_message_at"))


def health(query: StreamingQuery, name: str = "health") -> dict:
    """Sums of :func:`with_health` over the query's recent batches."""
    seen = [p.observedMetrics[name] for p in query.recentProgress if name in p.observedMetrics]
    newest = max((r.last_message_at for r in seen if r.last_message_at is not None), default=None)
    return {"processed": sum(r.processed for r in seen), "errors": sum(r.errors for r in seen), "last_message_at": newest}


def newest_alerts(spark: SparkSession, path: str, most: int = 50) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest alerts at ``path``, in the folder of the last batch; a replayed batch writes its own again.

    A batch goes on from the last one below it that is there, and then drops those below that
    one, which no replay needs; a query with a new checkpoint begins anew.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def written() -> list[int]:
        names = [x.getPath().getName() for x in store.listStatus(root)] if store.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit())

    def write(batch: DataFrame, number: int) -> None:
        earlier = [n for n in written() if n < number]
        before = spark.read.schema(batch.schema).parquet(f"{path}/{earlier[-1]}") if earlier else batch.limit(0)
        both = before.unionByName(batch)
        both.orderBy(F.col("ts").desc(), F.col("seq").desc(), "check_order").limit(most).write.mode("overwrite").parquet(f"{path}/{number}")
        for n in earlier[:-1]:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)

    return write


def batch_files(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer whose replays change nothing: a batch's rows are the folder of its number."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def ingest(record: DataFrame, history: DataFrame, **rules) -> DataFrame:
    """Alerts of single records against the readings before them: the stream's rules as a micro-batch, for what doesn't come by a topic."""
    from ..operators.telemetry import temperature_candidates, throttle

    every = history.unionByName(record).join(record.select("truck_id").distinct(), "truck_id", "left_semi")
    return throttle(temperature_candidates(every, **rules)).join(record.select("truck_id", "seq"), ["truck_id", "seq"], "left_semi")
