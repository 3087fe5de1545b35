"""A truck's memory of alerts on a stream, which each response reads and writes.

The memory is a list in the state store: the newest alerts of a truck, which live on while
the truck has an alert within the days. The store's own expiry, renewed by every write,
frees what nobody asks for any more; the rule itself goes by event time, so a replay or a
restart gives the same responses, and the batch form below gives them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST, TTL_DAYS, RECURRING, RISK = 100, 30, 2, 0.15
RESPONSE = "truck_id string, alert_type string, severity string, ts timestamp, seq long, similar_alerts long, action string, occurrence long, financial_risk double"
_ENTRY = T.StructType([T.StructField("alert_type", T.StringType()), T.StructField("at", T.LongType()), T.StructField("seq", T.LongType())])
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertMemory(StatefulProcessor):
    """Answers a truck's alerts one after another; what it has answered is in the memory that the next one reads."""

    def __init__(self, most: int, ttl_days: float, recurring: int, risk: float) -> None:
        self.most, self.ttl_days, self.recurring, self.risk = most, ttl_days, recurring, risk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerts = handle.getListState("alerts", _ENTRY, ttlDurationMs=int(self.ttl_days * 86_400_000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names are Spark's
        memory = [tuple(x) for x in self.alerts.get()] if self.alerts.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq", "alert_type"]).itertuples():
            at = r.ts.value // 1000
            if memory and at - memory[-1][1] > self.ttl_days * 86_400_000_000:
                memory = []
            similar = sum(m[0] == r.alert_type for m in memory)
            action = "escalate_maintenance" if similar >= self.recurring else "investigate"
            cargo = 0.0 if pd.isna(r.cargo_value_eur) else r.cargo_value_eur
            out.append((key[0], r.alert_type, r.severity, r.ts, r.seq, similar, action, similar + 1, round(cargo * self.risk, 2)))
            memory = [*memory, (r.alert_type, at, r.seq)][-self.most :]
        self.alerts.put(memory)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESPONSE.split(", ")])

    def close(self) -> None:
        pass


def use_state_lists(spark: SparkSession) -> None:
    """List state needs the RocksDB store; call it before the query starts. Batches without rows have nothing to do, as the rule goes by event time, and would go on for ever."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def responses(alerts: DataFrame, *, most: int = MOST, ttl_days: float = TTL_DAYS, recurring: int = RECURRING, risk: float = RISK) -> DataFrame:
    """RESPONSE rows of a stream of alerts (truck_id, alert_type, severity, ts, seq, cargo_value_eur): from ``recurring`` past alerts of the type on, the truck is escalated.

    Each truck remembers its newest ``most`` alerts, none of them once it had none for
    ``ttl_days``. Alerts of a micro-batch go by time; one that comes late is answered when it comes.
    """
    use_state_lists(alerts.sparkSession)
    cargo = F.col("cargo_value_eur") if "cargo_value_eur" in alerts.columns else F.lit(None).cast("double")
    rows = alerts.select("truck_id", "alert_type", "severity", "ts", "seq", cargo.cast("double").alias("cargo_value_eur"))
    return rows.groupBy("truck_id").transformWithStateInPandas(AlertMemory(most, ttl_days, recurring, risk), RESPONSE, "append", "processingTime")


def responses_of(alerts: DataFrame, *, most: int = MOST, ttl_days: float = TTL_DAYS, recurring: int = RECURRING, risk: float = RISK) -> DataFrame:
    """RESPONSE rows of alerts at rest, the same as :func:`responses` on them in order."""
    cargo = F.col("cargo_value_eur") if "cargo_value_eur" in alerts.columns else F.lit(None)
    order = Window.partitionBy("truck_id").orderBy("ts", "seq", "alert_type")
    silent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > F.lit(int(ttl_days * 86_400_000_000))
    lives = alerts.withColumn("_new", F.coalesce(silent.cast("int"), F.lit(0)))
    lives = lives.withColumn("_life", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("truck_id", "_life").orderBy("ts", "seq", "alert_type").rowsBetween(-most, -1)
    similar = F.size(F.filter("_types", lambda t: t == F.col("alert_type"))).cast("long")
    out = lives.withColumn("_types", F.collect_list("alert_type").over(before)).withColumn("similar_alerts", similar)
    action = F.when(F.col("similar_alerts") >= recurring, "escalate_maintenance").otherwise("investigate")
    return out.select("truck_id", "alert_type", "severity", "ts", "seq", "similar_alerts", action.alias("action"), (F.col("similar_alerts") + 1).alias("occurrence"), F.round(F.coalesce(cargo.cast("double"), F.lit(0.0)) * risk, 2).alias("financial_risk"))


def remembered(alerts: DataFrame, now: object, *, most: int = MOST, ttl_days: float = TTL_DAYS) -> DataFrame:
    """(truck_id, alert_type, ts, seq, position) of each truck's memory at a time, newest first: what a look-up gets then."""
    order = Window.partitionBy("truck_id").orderBy("ts", "seq", "alert_type")
    ttl = F.lit(int(ttl_days * 86_400_000_000))
    next_at = F.coalesce(F.unix_micros(F.lead("ts").over(order)), F.unix_micros(F.lit(now).cast("timestamp")))
    seen = alerts.filter(F.col("ts") <= F.lit(now).cast("timestamp")).withColumn("_ends", next_at - F.unix_micros("ts") > ttl)
    back = Window.partitionBy("truck_id").orderBy(F.col("ts").desc(), F.col("seq").desc(), F.col("alert_type").desc())
    alive = seen.withColumn("_ended", F.max(F.col("_ends")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return alive.withColumn("position", F.row_number().over(back)).filter((F.col("position") <= most) & ~F.col("_ended")).select("truck_id", "alert_type", "ts", "seq", "position")
