"""Invoice audit: line items against contract rates, banded discrepancies, and a report an invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("auto_approve", "investigate", "escalate", "critical")


def band(percentage: Column) -> Column:
    """Severity by the size of the percentage: under 1, 5 and 15, or more."""
    size = F.abs(percentage)
    return F.when(size < 1, BANDS[0]).when(size < 5, BANDS[1]).when(size < 15, BANDS[2]).otherwise(BANDS[3])


def band_order(column: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), column).cast("int") - 1


def current_rates(rates: DataFrame, *, keys: tuple[str, ...] = ("cargo_type",), version_col: str | None = None) -> DataFrame:
    """One rate for each key: the last by ``version_col``; without one the last in the order of the rows."""
    rest = [c for c in rates.columns if c not in (*keys, version_col)]
    ordered = rates if version_col else rates.withColumn("_row", F.monotonically_increasing_id())
    newest = F.max_by(F.struct(*rest), version_col or "_row")
    return ordered.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def discrepancies(lines: DataFrame, rates: DataFrame, *, version_col: str | None = None, strict: bool = False) -> DataFrame:
    """Lines that differ from the contract: expected and actual rate and total, |difference|, percentage, band.

    Lines join rates on cargo_type, null with null; those without a rate, with a zero rate
    or without a difference are left out. ``strict`` also joins on currency. The rate table
    is broadcast by Spark when it is small enough, and shuffled otherwise.
    """
    keys = ("cargo_type", "currency") if strict else ("cargo_type",)
    agreed = current_rates(rates, keys=keys, version_col=version_col).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("rate").alias("expected_rate"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = lines.join(agreed, on).drop(*(f"_{k}" for k in keys)).filter("expected_rate <> 0")
    expected = F.col("expected_rate") * F.col("quantity")
    change = (F.col("unit_price") - F.col("expected_rate")).cast("double") / F.col("expected_rate").cast("double") * 100
    out = joined.withColumn("expected_total", expected).withColumn("difference", F.col("total") - F.col("expected_total")).filter("difference <> 0")
    out = out.withColumn("percentage", F.round(change, 4)).withColumn("band", band(F.col("percentage")))
    return out.withColumn("difference", F.abs("difference")).withColumnRenamed("unit_price", "actual_rate").withColumnRenamed("total", "actual_total")


def summary_sentence(invoice: Column, vendor: Column, currency: Column, n: Column, total: Column, worst: Column) -> Column:
    head = F.concat(F.lit("Invoice "), invoice.cast("string"), F.lit(" from "), vendor.cast("string"), F.lit(": "))
    noun = F.when(n == 1, "discrepancy").otherwise("discrepancies")
    found = F.concat(n.cast("string"), F.lit(" "), noun, F.lit(" found totaling "), currency, F.lit(" "), total.cast("decimal(24,2)").cast("string"), F.lit(". Maximum severity: "), worst, F.lit("."))
    return F.concat(head, F.when(n > 0, found).otherwise("no discrepancies found. All rates match contract."))


def report(invoices: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each invoice: n_discrepancies, total_discrepancy, max_band, needs_approval and a sentence.

    Invoices without discrepancies are approved automatically.
    """
    per = found.groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("difference").alias("total"), F.max(band_order(F.col("band"))).alias("worst"))
    n, total, worst = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)), F.coalesce("worst", F.lit(0))
    name = F.element_at(F.array(*map(F.lit, BANDS)), worst + 1)
    joined = invoices.join(per, "invoice_id", "left")
    return joined.select(
        "invoice_id",
        n.alias("n_discrepancies"),
        total.cast("decimal(24,2)").alias("total_discrepancy"),
        name.alias("max_band"),
        (worst > 0).alias("needs_approval"),
        summary_sentence(F.col("invoice_id"), F.col("vendor"), F.col("currency"), n, total, name).alias("summary"),
    )


def invoices_with_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers beside their lines; an invoice without lines keeps one placeholder of zero amounts."""
    joined = headers.join(lines, "invoice_id", "left")
    zero = {c: 0 for c in ("quantity", "unit_price", "total") if c in joined.columns}
    return joined.withColumns({c: F.coalesce(c, F.lit(v).cast(joined.schema[c].dataType)) for c, v in zero.items()})


def transition(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve or reject reports that await approval; decisions on others are ignored, with ``applied`` false."""
    joined = reports.join(decisions.select("invoice_id", "decision"), "invoice_id", "left")
    applied = F.col("decision").isNotNull() & (F.col("status") == "awaiting_approval")
    return joined.withColumn("applied", F.coalesce(applied, F.lit(False))).withColumn("status", F.when(F.col("applied"), F.col("decision")).otherwise(F.col("status"))).drop("decision")
