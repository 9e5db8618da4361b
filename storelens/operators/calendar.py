"""The calendar cube: every date-keyed rollup from one scan.

The dashboard's date-keyed sections (KPIs, weekly, monthly, quarterly,
hourly, day-part, weekday, peak time, YTD metrics and changes, benefit YTD
and changes) need only additive measures: sums and counts.  ``calendar_cube``
aggregates the fact once to one row per (calendar day, hour), a table
bounded by the calendar (about 24 rows a day) however large the fact is.
Each ``*_from_cube`` function re-aggregates that small table and returns
exactly what the operator of the same name returns on the fact (sums stay
exact decimals until the final cast).  Sections that need distinct invoices
(penetration, category-with-benefit, products) cannot come from it and
keep scanning the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import (
    daypart,
    half_even,
    is_benefit,
    month_day_key,
    month_label,
    ratio,
    week_ending,
    weekday_label,
)
from ..functions.roles import ColumnRoles, roles_of
from . import benefits as ben
from . import rollups as ru
from . import yoy


def calendar_cube(df: DataFrame, pattern: str = K.BENEFIT_PATTERN, roles: ColumnRoles | None = None) -> DataFrame:
    """One row per (day, hour) with row count, price/cost sums and counts,
    and the same for the benefit lines.  Rows without a date form the
    (null, null) row, so totals still include them."""
    r = roles_of(df, roles, "date", "price", "cost")
    d = F.col(r.date)
    b = is_benefit(r.subcategory, pattern) if r.subcategory else F.lit(False)
    return df.groupBy(F.to_date(d).alias("day"), F.hour(d).alias("hour")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(r.price).alias("ps"),
        F.count(r.price).alias("pn"),
        F.sum(r.cost).alias("cs"),
        F.count(r.cost).alias("cn"),
        F.sum(F.when(b, F.col(r.price))).alias("bs"),
        F.count(F.when(b, F.col(r.price))).alias("bn"),
        F.sum(F.when(b, F.col(r.cost))).alias("bc"),
        F.count(F.when(b, F.lit(1))).alias("bl"),
    )


def _zsum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _dated(cube: DataFrame) -> DataFrame:
    return cube.where(F.col("day").isNotNull())


def sales_kpis_from_cube(cube: DataFrame) -> DataFrame:
    return cube.agg(_zsum("ps").cast("double").alias("total_sales"), _zsum("rows").alias("transactions")).select(
        "total_sales", "transactions", ratio("total_sales", "transactions").alias("avg_basket")
    )


def profit_kpis_from_cube(cube: DataFrame) -> DataFrame:
    return cube.agg(
        _zsum("ps").cast("double").alias("total_sales"),
        _zsum("cs").cast("double").alias("total_cogs"),
        (_zsum("ps") - _zsum("cs")).cast("double").alias("gross_profit"),
    ).select(
        "total_sales",
        "total_cogs",
        "gross_profit",
        F.when(F.col("total_sales") > 0, ratio("gross_profit", "total_sales") * 100.0)
        .otherwise(F.lit(0.0))
        .alias("profit_margin"),
    )


def weekly_sales_from_cube(cube: DataFrame) -> DataFrame:
    wk = week_ending("day").cast("timestamp_ntz").alias("week_ending")
    return ru.fill_weeks(_dated(cube).groupBy(wk).agg(_zsum("ps").cast("double").alias("sales")))


def _period(cube: DataFrame, keys) -> DataFrame:
    return (
        _dated(cube)
        .groupBy(*keys)
        .agg(_zsum("ps").alias("rev"), _zsum("cs").alias("cst"))
    )


def monthly_profit_from_cube(cube: DataFrame) -> DataFrame:
    months = _period(cube, [F.year("day").alias("year"), F.month("day").alias("month")])
    return ru.month_rows(months)


def quarterly_profit_from_cube(cube: DataFrame) -> DataFrame:
    quarters = _period(cube, [F.year("day").alias("year"), F.quarter("day").alias("quarter")])
    return ru.quarter_rows(quarters)


def _hours(cube: DataFrame) -> DataFrame:
    return _dated(cube).groupBy("hour").agg(_zsum("ps").alias("s"), _zsum("pn").alias("n"))


def hourly_sales_from_cube(cube: DataFrame) -> DataFrame:
    h = _hours(cube).select(
        "hour",
        F.col("s").cast("double").alias("total_sales"),
        F.col("n").alias("transaction_count"),
        F.try_divide(F.col("s").cast("double"), F.col("n").cast("double")).alias("avg_transaction"),
    )
    return ru.label_hours(h)


def daypart_sales_from_cube(cube: DataFrame) -> DataFrame:
    out = (
        _dated(cube)
        .groupBy(daypart("hour").alias("time_period"))
        .agg(_zsum("ps").cast("double").alias("total_sales"), _zsum("pn").alias("transaction_count"))
    )
    return ru._sorted_few(out, F.desc_nulls_last("total_sales"), F.asc("time_period"))


def weekday_sales_from_cube(cube: DataFrame) -> DataFrame:
    out = (
        _dated(cube)
        .groupBy(F.weekday("day").alias("day_num"))
        .agg(_zsum("ps").cast("double").alias("total_sales"), _zsum("pn").alias("transaction_count"))
        .select(weekday_label("day_num").alias("day_of_week"), "day_num", "total_sales", "transaction_count")
    )
    return ru._sorted_few(out, "day_num")


def peak_time_from_cube(cube: DataFrame) -> DataFrame:
    return ru.peak_from_hours(_hours(cube))


def _as_of_key(cube: DataFrame, as_of) -> Column:
    """The YTD key: the latest day of the cube (same month/day as the latest
    timestamp), or the given date."""
    if as_of is None:
        return cube.select(month_day_key(F.max("day"))).scalar()
    if isinstance(as_of, Column):
        return month_day_key(as_of)
    return month_day_key(F.lit(str(as_of)).cast("timestamp_ntz"))


def _ytd(cube: DataFrame, as_of) -> DataFrame:
    return _dated(cube).where(month_day_key("day") <= _as_of_key(cube, as_of))


def _mean(s: str, n: str) -> Column:
    return F.try_divide(F.sum(s).cast("double"), F.sum(n).cast("double"))


def ytd_metrics_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return (
        _ytd(cube, as_of)
        .groupBy(F.year("day").alias("year"))
        .agg(
            half_even(_zsum("ps").cast("double"), 2).alias("total_revenue"),
            half_even(_mean("ps", "pn"), 2).alias("avg_sale_price"),
            _zsum("pn").alias("transaction_count"),
            half_even(_zsum("cs").cast("double"), 2).alias("total_cost"),
            half_even(_mean("cs", "cn"), 2).alias("avg_unit_cost"),
        )
        .transform(yoy.with_ytd_profit)
    )


def ytd_changes_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return yoy.ytd_changes_from(ytd_metrics_from_cube(cube, as_of))


def benefit_year_summary_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return (
        _ytd(cube, as_of)
        .groupBy(F.year("day").alias("year"))
        .agg(
            half_even(_zsum("ps").cast("double"), 2).alias("total_revenue"),
            _zsum("bl").alias("benefit_lines"),
            half_even(_zsum("bs").cast("double"), 2).alias("total_benefit_value"),
            _zsum("bn").alias("benefit_count"),
            half_even(_mean("bs", "bn"), 2).alias("avg_benefit_value"),
            half_even(_zsum("bc").cast("double"), 2).alias("total_benefit_cost"),
        )
        .withColumn("benefit_profit_impact", F.col("total_benefit_value") - F.col("total_benefit_cost"))
    )


def benefit_monthly_from_cube(cube: DataFrame) -> DataFrame:
    """BEN-2: benefit value per month (all dates), months with benefit lines."""
    return (
        _dated(cube)
        .groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(_zsum("bl").alias("lines"), _zsum("bs").cast("double").alias("benefit_value"))
        .where(F.col("lines") > 0)
        .select("year", "month", month_label("year", "month").alias("year_month"), "benefit_value")
    )


def benefit_ytd_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return ben.benefit_ytd_from(benefit_year_summary_from_cube(cube, as_of))


def benefit_changes_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return ben.benefit_changes_from(benefit_year_summary_from_cube(cube, as_of))


def benefit_revenue_share_from_cube(cube: DataFrame, as_of=None) -> DataFrame:
    return ben.benefit_revenue_share_from(benefit_year_summary_from_cube(cube, as_of))


def yoy_readiness_from_cube(cube: DataFrame) -> DataFrame:
    """INS-7 from the cube: months with revenue > 0, years, and whether the
    year-over-year block has enough data (same as ``yoy.yoy_readiness``)."""
    months = _dated(cube).groupBy(F.year("day").alias("year"), F.month("day").alias("month")).agg(
        _zsum("ps").alias("rev")
    )
    return months.agg(
        F.count(F.when(F.col("rev") > 0, F.lit(1))).alias("months_with_revenue"),
        F.count_distinct("year").alias("years"),
    ).select(
        "months_with_revenue",
        "years",
        ((F.col("months_with_revenue") >= 2) & (F.col("years") >= 2)).alias("ready"),
    )
