"""Order statistics from counts of values, with ranges summed apart: no task orders all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
#: Rows of a key below which it is one range whatever the table's size, and sampled rows for each range.
WHOLE, SAMPLED = 50_000, 50


def ranges_of(rows: DataFrame, key: str, order: list[Column], ranges: int | None = None) -> Column:
    """A number that cuts each large key's rows into ranges along ``order``, 0 for all rows of a small key.

    Keys over a quarter of an even share are large, so there are few, and their bounds come
    from a hash sample of their rows; both go through the driver and grow with ``ranges``
    alone. Bounds only decide what is looked at together. ``order`` holds no nulls.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    large = {r[0]: r.n for r in counts.filter(F.col("n") > max(WHOLE, total // (4 * ranges))).collect()}
    if not large or ranges < 2:
        return F.lit(0)
    hot = F.coalesce(F.col(key).isin([k for k in large if k is not None]), F.lit(None in large))
    named = [c.alias(f"_{i}") for i, c in enumerate(order)]
    place = F.pmod(F.xxhash64(*order), F.lit(1 << 30))
    some = rows.filter(hot & (place < min(1 << 30, (SAMPLED * ranges << 30) // sum(large.values())))).select(*named).orderBy(F.xxhash64(*(f"_{i}" for i in range(len(order))))).limit(2 * SAMPLED * ranges)
    seen = sorted({tuple(r) for r in some.collect()})
    bounds = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []
    mine = F.struct(*named)

    def search(low: int, high: int) -> Column:
        """How many of the bounds are not above the row, as a tree of comparisons."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(mine < F.struct(*(F.lit(v).alias(f"_{i}") for i, v in enumerate(bounds[middle]))), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(hot, search(0, len(bounds))).otherwise(0)


def with_before(rows: DataFrame, column: str, weight: str, *, by: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the rows of a smaller ``column`` in their group; ``column`` differs within a group.

    The numbers are cut into ranges at approximate quantiles, which only decide what is
    summed together: each range is summed in order, then the ranges of a group.
    """
    marks = rows.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 1000).alias("m")).first().m or []
    marks = F.array(*(F.lit(m) for m in sorted(set(marks)))) if marks else F.array().cast("array<double>")
    cut = rows.withColumn("_range", F.size(F.filter(marks, lambda m: m < F.col(column))))
    unbounded = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = unbounded(Window.partitionBy(*by, "_range").orderBy(column))
    earlier = unbounded(Window.partitionBy(*by).orderBy("_range"))
    sums = cut.groupBy(*by, "_range").agg(F.sum(weight).alias("_w")).withColumn("_base", F.coalesce(F.sum("_w").over(earlier), F.lit(0))).drop("_w")
    keys = [*by, "_range"]
    out = cut.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(sums, keys)
    return out.withColumn("before", F.col("_base") + F.col("_in")).select(*rows.columns, "before")


def elements_at(rows: DataFrame, column: str, by: str, places: dict[str, str]) -> DataFrame:
    """(by, name, ...): the element of each group at each place, an expression of its size ``n``, from 0 in ascending order."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(by).agg(F.sum("c").alias("n"))
    placed = with_before(counts, column, "c", by=(by,)).join(sizes, by)
    at = lambda e: F.max(F.when((F.col("before") <= F.expr(e)) & (F.expr(e) < F.col("before") + F.col("c")), F.col(column)))
    return placed.groupBy(by).agg(*(at(e).alias(name) for name, e in places.items()))
