"""Token cost, drift of quality metrics, prompt caching and routing cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prices for a million tokens, and cost of a query by tier.
PRICES = (("gpt-5-nano", "0.05", "0.40"), ("gpt-5-mini", "0.25", "2.00"), ("gpt-5.2", "1.75", "14.00"))
TIER_COSTS = (("simple", 0.0004), ("medium", 0.003), ("complex", 0.014))
CLASSIFIER_COST = 0.000025
SECTION_ORDER = ("STATIC", "SESSION_STABLE", "DYNAMIC")
SEVERITIES = ("GREEN", "YELLOW", "RED")


def pricing_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    rows = spark.createDataFrame(list(prices), "model string, input_price string, output_price string")
    return rows.select("model", F.col("input_price").cast("decimal(10,4)").alias("input_price"), F.col("output_price").cast("decimal(10,4)").alias("output_price"))


def with_cost(traces: DataFrame, pricing: DataFrame, *, unknown: str = "error") -> DataFrame:
    """Adds ``cost`` as decimal(18,8): tokens times price for a million; cache hits and empty calls are free.

    An unknown model of a call that is not free is an error, or costs 0 with ``unknown='zero'``.
    """
    free = F.col("cache_hit") | ((F.col("prompt_tokens") == 0) & (F.col("completion_tokens") == 0))
    part = lambda n, p: F.col(n).cast("decimal(14,0)") * F.col(p) / F.lit(1_000_000).cast("decimal(8,0)")
    paid = (part("prompt_tokens", "input_price") + part("completion_tokens", "output_price")).cast("decimal(18,8)")
    missing = F.lit(0).cast("decimal(18,8)") if unknown == "zero" else F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce("model", F.lit("null")))).cast("decimal(18,8)")
    cost = F.when(free, F.lit(0).cast("decimal(18,8)")).when(F.col("input_price").isNull(), missing).otherwise(paid)
    return traces.join(pricing, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def in_period(rows: DataFrame, start: Column, end: Column, *, ts: str = "ts") -> DataFrame:
    """Rows of a period, both ends included."""
    return rows.filter(F.col(ts).between(start, end))


def period_start(period: str, now: Column) -> Column:
    """The start of a period such as 7d or 24h that ends now."""
    if not period[:-1].isdigit() or period[-1:] not in ("d", "h"):
        raise ValueError(f"not a period: {period!r}")
    return now - F.make_dt_interval(**{"days" if period[-1] == "d" else "hours": F.lit(int(period[:-1]))})


def cost_by(costs: DataFrame, key: str) -> DataFrame:
    """Cost and queries of each key; rows without one are left out."""
    own = costs.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return own.groupBy(key).agg(F.sum("cost").alias("total_cost"), F.count("*").alias("queries"))


def cost_summary(costs: DataFrame) -> DataFrame:
    """One row: total, queries, average (0 when empty), cache-hit rate and a map of cost by agent.

    Rows are added up by agent first, so one task sees an agent a row.
    """
    per = costs.groupBy("agent_name").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"))
    total, n = F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    rate = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    agents = F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent_name", "cost"))))
    return per.agg(total.alias("total_cost"), n.alias("total_queries"), F.round(rate(total.cast("double")), 8).alias("avg_cost"), F.round(rate(F.sum("hits")), 8).alias("cache_hit_rate"), agents.alias("by_agent"))


def drift_severity(delta: Column, *, yellow: float = 0.02, red: float = 0.05) -> Column:
    """A fall of a score: GREEN up to yellow, RED from red on."""
    fall = F.round(-delta, 9)
    return F.when(fall >= red, "RED").when(fall >= yellow, "YELLOW").otherwise("GREEN")


def drift_alerts(baseline: DataFrame, current: DataFrame, *, yellow: float = 0.02, red: float = 0.05) -> DataFrame:
    """(model, metric, baseline, current, delta, severity) of the metrics that both tables have, falls only."""
    both = baseline.withColumnRenamed("score", "baseline").join(current.withColumnRenamed("score", "current"), ["model", "metric"])
    out = both.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 9))
    return out.withColumn("severity", drift_severity(F.col("delta"), yellow=yellow, red=red)).filter("severity <> 'GREEN'")


def worst_severity(alerts: DataFrame) -> DataFrame:
    """The worst severity of each model."""
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return alerts.groupBy("model").agg(F.max(order).alias("o"), F.count("*").alias("n")).select("model", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("o")).alias("severity"), "n")


def version_changes(versions: DataFrame) -> DataFrame:
    """Adds previous_version and changed, true on the first row and where the version differs from the one before."""
    order = Window.partitionBy("model").orderBy("ts", "seq")
    before = versions.withColumn("previous_version", F.lag("version").over(order))
    return before.withColumn("changed", F.coalesce(F.col("previous_version") != F.col("version"), F.lit(True)))


def current_versions(versions: DataFrame) -> DataFrame:
    """(model, version, since): the last version of each model and the first time of its last run of rows."""
    order = Window.partitionBy("model").orderBy("ts", "seq")
    changes = version_changes(versions).filter("changed")
    return changes.withColumn("_n", F.row_number().over(order)).groupBy("model").agg(F.max_by("version", "_n").alias("version"), F.max("ts").alias("since"))


def estimated_tokens(content: Column) -> Column:
    return F.floor(F.length(F.coalesce(content, F.lit(""))) / 4).cast("long")


def cache_friendliness(sections: DataFrame) -> DataFrame:
    """(prompt_id, static_ratio, cacheable_ratio, score) of prompts given as (prompt_id, position, section_type, content).

    The score is the cacheable share times the share of it that comes before the first
    dynamic section; 0 for prompts without tokens or without cacheable ones.
    """
    own = Window.partitionBy("prompt_id")
    dynamic = F.min(F.when(F.col("section_type") == "DYNAMIC", F.col("position"))).over(own)
    rows = sections.withColumn("t", estimated_tokens(F.col("content"))).withColumn("first_dynamic", dynamic)
    add = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("t"))), F.lit(0))
    before = F.col("first_dynamic").isNull() | (F.col("position") < F.col("first_dynamic"))
    sums = rows.groupBy("prompt_id").agg(F.sum("t").alias("total"), add(F.col("section_type") == "STATIC").alias("static"), add(F.col("section_type") != "DYNAMIC").alias("cacheable"), add(before).alias("prefix"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("prompt_id", F.round(share("static", "total"), 6).alias("static_ratio"), F.round(share("cacheable", "total"), 6).alias("cacheable_ratio"), F.round(share("cacheable", "total") * share("prefix", "cacheable"), 6).alias("score"))


def restructured(sections: DataFrame) -> DataFrame:
    """Adds new_position: static sections first, dynamic last, in their old order within a kind."""
    kind = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section_type"))
    order = Window.partitionBy("prompt_id").orderBy(kind, "position")
    return sections.withColumn("new_position", F.row_number().over(order) - 1)


def prompt_cache(queries: DataFrame, *, key: str = "partition_key") -> DataFrame:
    """One row: the first query of each partition misses, the others hit."""
    per = queries.groupBy(key).agg(F.count("*").alias("n"))
    n, misses = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    hits = F.when(n > 0, (n - misses) / n).otherwise(0.0)
    return per.agg(n.alias("total_prompts"), (n - misses).alias("hits"), misses.alias("misses"), F.round(hits, 6).alias("hit_rate"))


def daily_savings(queries: Column, tokens: Column, static_ratio: Column, hit_rate: Column, price_1k: Column, *, discount: float = 0.5) -> Column:
    return queries * tokens * static_ratio * hit_rate / 1000 * price_1k * discount


def routing_costs(mix: DataFrame, *, misclass_rate: float = 0.05) -> DataFrame:
    """Routed against unrouted cost a day of each scenario (scenario, queries, simple, medium, complex)."""
    shares = sum((F.col(t) * c for t, c in TIER_COSTS), F.lit(0.0))
    routed = F.col("queries") * shares + F.col("queries") * CLASSIFIER_COST
    unrouted = F.col("queries") * dict(TIER_COSTS)["complex"]
    return mix.select(
        "scenario",
        F.round(routed, 4).alias("routed_daily"),
        F.round(unrouted, 4).alias("unrouted_daily"),
        F.round(F.when(unrouted > 0, (unrouted - routed) / unrouted * 100).otherwise(0.0), 1).alias("savings_pct"),
        F.round(F.col("queries") * F.col("complex") * misclass_rate, 1).alias("misclassified"),
    )


def reconciled(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Traces of both stores, each trace_id once; those that only the fallback has are marked."""
    both = primary.withColumn("reconciled", F.lit(False)).unionByName(fallback.withColumn("reconciled", F.lit(True)))
    rest = [c for c in both.columns if c not in ("trace_id", "reconciled")]
    best = both.groupBy("trace_id").agg(F.min(F.struct("reconciled", *rest)).alias("r"))
    return best.select("trace_id", "r.*").select(*both.columns)


def chain_stats(responses: DataFrame) -> DataFrame:
    """Requests, fallbacks and cache fallbacks of each provider, from (provider, is_fallback, from_cache)."""
    return responses.groupBy("provider").agg(F.count("*").alias("requests"), F.count_if("is_fallback").alias("fallbacks"), F.count_if("from_cache").alias("cache_fallbacks"))
