"""Distinct invoices that merge: HyperLogLog sketches instead of invoice lists.

The exact counts (``benefits.benefit_penetration``, ``products.product_stats``)
shuffle one row per (key, invoice).  Here each task folds its invoices into
sketches of bounded size, only sketches travel, and sketches of days or months
add up to any span.  The price is an error: with ``2**lg_k`` registers one
standard error of a merged count is about ``1.04 / sqrt(2**lg_k)`` (1.6 percent
at the default 12, in at most 4 KB a sketch); small counts are exact.  Exact
counts stay the default of the operators; nothing here replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.exprs import half_even, is_benefit, percent_or_zero
from ..functions.roles import ColumnRoles, roles_of
from .filters import year_to_date
from .yoy import latest_two_years

LG_K = 12
_SKETCHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged sketch's estimate."""
    return 1.04 / 2 ** (lg_k / 2)


def invoice_sketch(df: DataFrame, invoice: str, lg_k: int = LG_K, where: Column | None = None) -> Column:
    """Aggregate: the sketch of the non-null invoices (of the rows ``where`` holds)."""
    kind = df.schema[invoice].dataType
    key = F.col(invoice) if isinstance(kind, _SKETCHED) else F.col(invoice).cast("string")
    return F.hll_sketch_agg(key if where is None else F.when(where, key), F.lit(lg_k))


def merged(sketch: str) -> Column:
    """Aggregate: distinct invoices of all sketches of the group together."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))


def day_sketches(df: DataFrame, pattern: str = K.BENEFIT_PATTERN, lg_k: int = LG_K, roles: ColumnRoles | None = None) -> DataFrame:
    """One row per day: sketches of all invoices and of those with a benefit
    line.  Bounded by the calendar; fit to be written and added to day by day."""
    r = roles_of(df, roles, "date", "subcategory", "invoice")
    rows = df.where(F.col(r.date).isNotNull())
    return rows.groupBy(F.to_date(r.date).cast("timestamp_ntz").alias("day")).agg(
        invoice_sketch(df, r.invoice, lg_k).alias("invoices"),
        invoice_sketch(df, r.invoice, lg_k, is_benefit(r.subcategory, pattern)).alias("benefit_invoices"),
    )


def penetration_from_sketches(days: DataFrame, as_of=None) -> DataFrame:
    """PEN-1 from day sketches: per year, over the days up to the as-of day of
    the year (default: the latest day), estimated invoices and rate %."""
    ytd = year_to_date(days, as_of, ColumnRoles(date="day"))
    out = ytd.groupBy(F.year("day").alias("year")).agg(
        merged("invoices").alias("total_invoices"), merged("benefit_invoices").alias("benefit_invoices")
    )
    return out.withColumn("penetration_rate", percent_or_zero("benefit_invoices", "total_invoices"))


def penetration_changes_from_sketches(days: DataFrame, as_of=None) -> DataFrame:
    """YOY-7 from day sketches."""
    two = latest_two_years(penetration_from_sketches(days, as_of), ["penetration_rate", "benefit_invoices"])
    return two.select(
        "prev_year",
        "cur_year",
        F.col("cur_penetration_rate").alias("current_rate"),
        F.col("prev_penetration_rate").alias("previous_rate"),
        (F.col("cur_penetration_rate") - F.col("prev_penetration_rate")).alias("rate_change"),
        F.col("cur_benefit_invoices").alias("current_benefit_invoices"),
        (F.col("cur_benefit_invoices") - F.col("prev_benefit_invoices")).alias("invoices_change"),
    )


def product_sketches(df: DataFrame, lg_k: int = LG_K, roles: ColumnRoles | None = None) -> DataFrame:
    """One row per month and product: sums, and the sketch of its invoices
    (rows without a date form the null month)."""
    r = roles_of(df, roles, "date", "subcategory", "product", "quantity", "price", "invoice")
    rows = df.where(F.col(r.subcategory).isNotNull() & F.col(r.product).isNotNull())
    return rows.groupBy(F.trunc(r.date, "MM").alias("month"), r.subcategory, r.product).agg(
        F.sum(r.quantity).alias("quantity_sum"),
        F.sum(r.price).alias("price_sum"),
        F.count(r.price).alias("price_count"),
        invoice_sketch(df, r.invoice, lg_k).alias("invoices"),
    )


def product_stats_from_sketches(months: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """PRD-2 from month sketches (of all months, or those that were kept):
    exact sums, estimated invoices."""
    r = roles_of(months, roles, "subcategory", "product")
    price = F.coalesce(F.sum("price_sum"), F.lit(0)).cast("double")
    return months.groupBy(r.subcategory, r.product).agg(
        half_even(F.coalesce(F.sum("quantity_sum"), F.lit(0.0)), 2).alias("total_quantity"),
        half_even(price, 2).alias("total_sales"),
        half_even(F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_count").cast("double")), 2).alias("avg_price"),
        merged("invoices").alias("unique_transactions"),
    )


def within(estimate: str, exact: str, lg_k: int = LG_K, errors: float = 4.0) -> Column:
    """Whether an estimate lies within so many standard errors of the exact count."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.lit(errors * standard_error(lg_k)) * F.col(exact)
