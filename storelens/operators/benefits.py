"""Member-benefit analysis.

Benefit lines are the rows whose subcategory contains the benefit pattern
(case-insensitive, literal).  All YTD operators share one as-of date: the
latest timestamp of the input (a scalar subquery), independent of how many
years exist.

Distinct invoice counts are two-level aggregations: first one row per
(year, invoice) with a partial map-side combine, then a count per year.
A hot invoice or year collapses map-side, and the shuffle is keyed by the
high-cardinality invoice id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import (
    half_even,
    is_benefit,
    mean,
    money_sum,
    percent_or_zero,
    ratio,
    month_label,
    ytd_mask,
)
from ..functions.roles import ColumnRoles, roles_of
from .filters import as_of_key
from .yoy import latest_two_years


def _ytd(df: DataFrame, r: ColumnRoles, as_of) -> DataFrame:
    return df.where(F.col(r.date).isNotNull() & ytd_mask(r.date, as_of_key(df, as_of, r)))


def benefit_lines(df: DataFrame, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None) -> DataFrame:
    r = roles_of(df, roles, "subcategory")
    return df.where(is_benefit(r.subcategory, pattern))


def benefit_year_summary(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """Per year, over the YTD rows, in one aggregation: total revenue (rounded
    2, as YTD-1) and the benefit lines' value, count, mean, cost (rounded 2)
    and profit impact; ``benefit_lines`` counts them (0 = no benefit year)."""
    r = roles_of(df, roles, "date", "subcategory", "price")
    b = is_benefit(r.subcategory, pattern)
    value = F.when(b, F.col(r.price))
    cost = half_even(money_sum(F.when(b, F.col(r.cost))), 2) if r.cost else F.lit(0.0)
    return (
        _ytd(df, r, as_of)
        .groupBy(F.year(r.date).alias("year"))
        .agg(
            half_even(money_sum(r.price), 2).alias("total_revenue"),
            F.count(F.when(b, F.lit(1))).alias("benefit_lines"),
            half_even(money_sum(value), 2).alias("total_benefit_value"),
            F.count(value).alias("benefit_count"),
            half_even(mean(value), 2).alias("avg_benefit_value"),
            cost.alias("total_benefit_cost"),
        )
        .withColumn("benefit_profit_impact", F.col("total_benefit_value") - F.col("total_benefit_cost"))
    )


def benefit_ytd(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """BEN-1: benefit value, count, mean, cost (rounded 2) and profit impact
    per year, YTD (years with at least one benefit line)."""
    return benefit_ytd_from(benefit_year_summary(df, pattern, as_of, roles))


def benefit_ytd_from(summary: DataFrame) -> DataFrame:
    """BEN-1 from a benefit year summary."""
    return summary.where(F.col("benefit_lines") > 0).select(
        "year", "total_benefit_value", "benefit_count", "avg_benefit_value", "total_benefit_cost",
        "benefit_profit_impact",
    )


def benefit_monthly(df: DataFrame, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None) -> DataFrame:
    """BEN-2: benefit value per month over all dates."""
    r = roles_of(df, roles, "date", "subcategory", "price")
    d = F.col(r.date)
    return (
        df.where(d.isNotNull() & is_benefit(r.subcategory, pattern))
        .groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
        .agg(money_sum(r.price).alias("benefit_value"))
        .select("year", "month", month_label("year", "month").alias("year_month"), "benefit_value")
    )


def _benefit_two_years(df: DataFrame, pattern: str, as_of, roles) -> DataFrame:
    return _two_from(benefit_year_summary(df, pattern, as_of, roles))


def _two_from(summary: DataFrame) -> DataFrame:
    """Latest and previous benefit year of the YTD summary, one row."""
    years = summary.where(F.col("benefit_lines") > 0)
    return latest_two_years(
        years, ["total_benefit_value", "benefit_count", "benefit_profit_impact", "total_revenue"]
    )


def _changes(two: DataFrame) -> DataFrame:
    return two.select(
        "prev_year",
        "cur_year",
        (F.col("cur_total_benefit_value") - F.col("prev_total_benefit_value")).alias("value_change"),
        (F.col("cur_benefit_count") - F.col("prev_benefit_count")).alias("count_change"),
        (F.col("cur_benefit_profit_impact") - F.col("prev_benefit_profit_impact")).alias("profit_impact_change"),
        F.col("cur_total_revenue"),
    ).select(
        "*",
        F.abs("value_change").alias("abs_value_change"),
        F.when(F.col("value_change") < 0, F.lit("more")).otherwise(F.lit("less")).alias("direction"),
    )


def benefit_changes(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """YOY-5: change of benefit value, count and profit impact, latest vs. previous year.

    ``direction`` is 'more' redeemed when the value fell (redemptions are
    negative amounts), else 'less'.
    """
    return benefit_changes_from(benefit_year_summary(df, pattern, as_of, roles))


def benefit_changes_from(summary: DataFrame, with_revenue: bool = False) -> DataFrame:
    """YOY-5 from a benefit year summary (optionally with the latest year's
    YTD revenue, the insight rules' precondition)."""
    out = _changes(_two_from(summary))
    return out if with_revenue else out.drop("cur_total_revenue")


def benefit_changes_with_revenue(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """YOY-5 plus the latest year's YTD revenue (the rules' precondition)."""
    return benefit_changes_from(benefit_year_summary(df, pattern, as_of, roles), with_revenue=True)


def benefit_revenue_share(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """YOY-6: benefit value as % of YTD revenue for the two latest benefit years.

    Produced only when the latest year's revenue is > 0; the previous share
    is 0 when that year's revenue is not > 0.  Revenue and benefit value come
    from the same one-pass summary.
    """
    return benefit_revenue_share_from(benefit_year_summary(df, pattern, as_of, roles))


def benefit_revenue_share_from(summary: DataFrame) -> DataFrame:
    """YOY-6 from a benefit year summary."""
    two = _two_from(summary).where(F.col("cur_total_revenue") > 0)
    return two.select(
        "prev_year",
        "cur_year",
        F.col("prev_total_revenue").alias("total_revenue_previous"),
        F.col("cur_total_revenue").alias("total_revenue_current"),
        percent_or_zero("prev_total_benefit_value", "prev_total_revenue").alias("share_previous"),
        (ratio("cur_total_benefit_value", "cur_total_revenue") * 100.0).alias("share_current"),
    )


def benefit_penetration(
    df: DataFrame,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    roles: ColumnRoles | None = None,
    approx: bool = False,
) -> DataFrame:
    """PEN-1: distinct invoices, distinct benefit invoices and rate % per year (YTD).

    ``approx=True`` replaces the exact two-level count by HyperLogLog
    sketches (``approx_count_distinct``, ~1% error): one map-side pass and
    no shuffle by invoice, for very large data.
    """
    r = roles_of(df, roles, "date", "subcategory", "invoice")
    ytd = _ytd(df, r, as_of)
    if approx:
        b = is_benefit(r.subcategory, pattern)
        out = ytd.groupBy(F.year(r.date).alias("year")).agg(
            F.approx_count_distinct(r.invoice).alias("total_invoices"),
            F.approx_count_distinct(F.when(b, F.col(r.invoice))).alias("benefit_invoices"),
        )
        return out.withColumn("penetration_rate", percent_or_zero("benefit_invoices", "total_invoices"))
    per_invoice = ytd.groupBy(F.year(r.date).alias("year"), F.col(r.invoice).alias("inv")).agg(
        F.max(is_benefit(r.subcategory, pattern).cast("int")).alias("b")
    )
    return (
        per_invoice.groupBy("year")
        .agg(
            F.count("inv").alias("total_invoices"),
            F.coalesce(F.sum(F.when(F.col("inv").isNotNull(), F.col("b"))), F.lit(0)).cast("bigint").alias(
                "benefit_invoices"
            ),
        )
        .withColumn("penetration_rate", percent_or_zero("benefit_invoices", "total_invoices"))
    )


def penetration_changes(
    df: DataFrame, pattern: str = K.BENEFIT_PATTERN, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """YOY-7: penetration rate change (pp) and benefit-invoice change."""
    two = latest_two_years(benefit_penetration(df, pattern, as_of, roles), ["penetration_rate", "benefit_invoices"])
    return two.select(
        "prev_year",
        "cur_year",
        F.col("cur_penetration_rate").alias("current_rate"),
        F.col("prev_penetration_rate").alias("previous_rate"),
        (F.col("cur_penetration_rate") - F.col("prev_penetration_rate")).alias("rate_change"),
        F.col("cur_benefit_invoices").alias("current_benefit_invoices"),
        (F.col("cur_benefit_invoices") - F.col("prev_benefit_invoices")).alias("invoices_change"),
    )


def benefit_invoices(df: DataFrame, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None) -> DataFrame:
    """Distinct invoices holding at least one benefit line (any date)."""
    r = roles_of(df, roles, "subcategory", "invoice")
    return (
        df.where(is_benefit(r.subcategory, pattern) & F.col(r.invoice).isNotNull())
        .select(F.col(r.invoice).alias("__inv"))
        .distinct()
    )


def category_with_benefit(
    df: DataFrame,
    category: str = K.FOCUS_CATEGORY,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """FOOD-1: lines of ``category`` on invoices that hold a benefit line, YTD,
    per year: value, count, mean (rounded 2) and distinct invoices.

    The invoice list comes from all input rows (any date); the YTD cut is
    applied to the category lines afterwards.  Left-semi join on invoice
    between per-(year, invoice) partial sums and the distinct benefit
    invoices.
    """
    r = roles_of(df, roles, "date", "category", "subcategory", "price", "invoice")
    lines = _ytd(df, r, as_of).where(F.col(r.category) == F.lit(category))
    # One row per (year, invoice) before the join: the map-side partial
    # aggregate collapses an invoice holding a third of all lines, so the
    # join never sees more than one row per invoice and year.
    per_invoice = lines.groupBy(F.year(r.date).alias("year"), F.col(r.invoice).alias("inv")).agg(
        F.sum(r.price).alias("s"), F.count(r.price).alias("c")
    )
    hit = per_invoice.join(benefit_invoices(df, pattern, r), F.col("inv") == F.col("__inv"), "left_semi")
    return hit.groupBy("year").agg(
        half_even(money_sum("s"), 2).alias("category_value_with_benefit"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("category_items_count"),
        half_even(F.try_divide(F.sum("s").cast("double"), F.sum("c").cast("double")), 2).alias("avg_category_item_value"),
        F.count("inv").alias("category_invoices_with_benefit"),
    )


def category_ytd(
    df: DataFrame, category: str = K.FOCUS_CATEGORY, as_of=None, roles: ColumnRoles | None = None
) -> DataFrame:
    """FOOD-2: all lines of ``category`` (YTD): distinct invoices and sales per year."""
    r = roles_of(df, roles, "date", "category", "price", "invoice")
    lines = _ytd(df, r, as_of).where(F.col(r.category) == F.lit(category))
    per_invoice = lines.groupBy(F.year(r.date).alias("year"), F.col(r.invoice).alias("inv")).agg(
        F.sum(r.price).alias("s")
    )
    return per_invoice.groupBy("year").agg(
        F.count("inv").alias("total_category_invoices"), money_sum("s").alias("total_category_sales")
    )


def category_benefit_penetration(
    df: DataFrame,
    category: str = K.FOCUS_CATEGORY,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """FOOD-3: share of the category's invoices (YTD) that hold a benefit line, %.

    The distinct (year, invoice) pairs of the category lines are left-joined
    with the distinct benefit invoices and counted per year.  Rows for the
    years in which at least one such invoice exists (the years FOOD-1
    reports).
    """
    r = roles_of(df, roles, "date", "category", "subcategory", "invoice")
    lines = _ytd(df, r, as_of).where(F.col(r.category) == F.lit(category))
    # Distinct (year, invoice) first: a hot invoice collapses map-side.
    invoices = lines.select(F.year(r.date).alias("year"), F.col(r.invoice).alias("inv")).distinct()
    flagged = invoices.join(
        benefit_invoices(df, pattern, r).withColumn("hb", F.lit(1)), F.col("inv") == F.col("__inv"), "left"
    )
    return (
        flagged.groupBy("year")
        .agg(
            F.count("inv").alias("total_category_invoices"),
            F.coalesce(F.sum(F.when(F.col("inv").isNotNull(), F.col("hb"))), F.lit(0)).cast("bigint").alias(
                "category_invoices_with_benefit"
            ),
        )
        .where(F.col("category_invoices_with_benefit") > 0)
        .withColumn("category_penetration", percent_or_zero("category_invoices_with_benefit", "total_category_invoices"))
    )


def category_penetration_change(
    df: DataFrame,
    category: str = K.FOCUS_CATEGORY,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """YOY-8: change (pp) of the category benefit penetration, latest vs. previous year."""
    two = latest_two_years(category_benefit_penetration(df, category, pattern, as_of, roles), ["category_penetration"])
    return two.select(
        "prev_year",
        "cur_year",
        F.col("cur_category_penetration").alias("current_rate"),
        F.col("prev_category_penetration").alias("previous_rate"),
        (F.col("cur_category_penetration") - F.col("prev_category_penetration")).alias("penetration_change"),
    )
