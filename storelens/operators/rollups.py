"""Single-level rollups of the purchases fact.

Each is one ``groupBy().agg()``: Spark does a map-side partial aggregate,
so even a key holding a third of all rows shrinks to one row per map task
before the shuffle.  Null keys are removed before grouping (pandas drops
them; Spark would keep a null group).  Money is summed exactly as decimal
and turned into double only in the final projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.exprs import (
    daypart,
    first_word,
    hour_label,
    is_benefit,
    mean,
    money_sum,
    month_label,
    percent,
    quarter_label,
    ratio,
    week_ending,
    weekday_label,
)
from ..functions.roles import ColumnRoles, resolve_roles, roles_of


def _desc_then(key: str, by: str):
    return [F.desc_nulls_last(by), F.asc(key)]


def _sorted_few(df: DataFrame, *order) -> DataFrame:
    """Sort a result whose row count is bounded by the calendar (24 hours,
    7 weekdays, 4 day-parts) inside one partition: no range exchange and no
    sampling job.  Open-ended keys (vendors, products) use a global sort."""
    return df.coalesce(1).sortWithinPartitions(*order)


def sales_kpis(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """KPI-1: total sales, transactions (rows), average basket."""
    r = roles_of(df, roles)
    total = money_sum(r.price) if r.price else F.lit(None).cast("double")
    return df.agg(total.alias("total_sales"), F.count(F.lit(1)).alias("transactions")).select(
        "total_sales", "transactions", ratio("total_sales", "transactions").alias("avg_basket")
    )


def profit_kpis(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """KPI-2: COGS, gross profit and margin % (0 when sales <= 0)."""
    r = roles_of(df, roles, "price", "cost")
    sales = F.coalesce(F.sum(r.price), F.lit(0))
    cogs = F.coalesce(F.sum(r.cost), F.lit(0))
    return df.agg(
        sales.cast("double").alias("total_sales"),
        cogs.cast("double").alias("total_cogs"),
        (sales - cogs).cast("double").alias("gross_profit"),
    ).select(
        "total_sales",
        "total_cogs",
        "gross_profit",
        F.when(F.col("total_sales") > 0, ratio("gross_profit", "total_sales") * 100.0)
        .otherwise(F.lit(0.0))
        .alias("profit_margin"),
    )


def scope_summary(filtered: DataFrame, original: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """KPI-3: rows and distinct categories of the filtered data vs. all data."""
    r = roles_of(filtered, roles, "category")
    c = F.col(r.category)
    all_categories = original.agg(F.count_distinct(c)).scalar()
    return filtered.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct(c).alias("categories")
    ).select(
        "total_records",
        "categories",
        all_categories.alias("all_categories"),
        (F.col("categories") < all_categories).alias("is_subset"),
    )


def selected_categories(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """PRJ-23: the comma-joined sorted list of categories present.

    Distinct first (partial aggregation, one row per category), then one
    small list; categories are a dimension, not a growing fact.
    """
    r = roles_of(df, roles, "category")
    cats = df.select(F.col(r.category).cast("string").alias("c")).where(F.col("c").isNotNull()).distinct()
    return cats.agg(F.array_join(F.sort_array(F.collect_list("c")), ", ").alias("categories"))


def weekly_sales(df: DataFrame, by_location: bool = False, roles: ColumnRoles | None = None) -> DataFrame:
    """WK-1 / WK-2: sales per week ending Sunday.

    By location: only weeks with rows.  Combined: every week from the first
    to the last, empty weeks with 0 (the calendar has one row per week, so
    it is tiny even for decades of data).
    """
    r = roles_of(df, roles, "date", "price", *(("location",) if by_location else ()))
    base = df.where(F.col(r.date).isNotNull())
    # Labels are midnight timestamps, like pandas' weekly Grouper.
    wk = week_ending(r.date).cast("timestamp_ntz").alias("week_ending")
    if by_location:
        return (
            base.where(F.col(r.location).isNotNull())
            .groupBy(wk, F.col(r.location))
            .agg(money_sum(r.price).alias("sales"))
        )
    return fill_weeks(base.groupBy(wk).agg(money_sum(r.price).alias("sales")))


def fill_weeks(weekly: DataFrame) -> DataFrame:
    """Every week from the first to the last of ``(week_ending, sales)``, 0 where missing."""
    # One pass: the weeks (a calendar's worth of rows) become one map.
    one = weekly.agg(
        F.min("week_ending").alias("lo"),
        F.max("week_ending").alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("week_ending", "sales"))).alias("s"),
    )
    weeks = one.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 7 DAYS"))).alias("week_ending"), "s")
    return weeks.select("week_ending", F.coalesce(F.try_element_at("s", F.col("week_ending")), F.lit(0.0)).alias("sales"))


def top_locations(df: DataFrame, n: int = 10, roles: ColumnRoles | None = None) -> DataFrame:
    """LOC-1 / TOP-2: locations by sales, top ``n`` (location words without 'site')."""
    r = roles if roles is not None else resolve_roles(df.schema, K.RANKING_LOCATION_WORDS)
    r.require("location", "price")
    loc = r.location
    return (
        df.where(F.col(loc).isNotNull())
        .groupBy(loc)
        .agg(money_sum(r.price).alias("sales"))
        .orderBy(*_desc_then(loc, "sales"))
        .limit(n)
    )


def profit_by_subcategory(df: DataFrame, n: int | None = None, roles: ColumnRoles | None = None) -> DataFrame:
    """SUB-1 / TOP-3: revenue, COGS, profit, margin % (1 digit) per subcategory, by profit."""
    r = roles_of(df, roles, "subcategory", "price", "cost")
    sub = r.subcategory
    agg = (
        df.where(F.col(sub).isNotNull())
        .groupBy(sub)
        .agg(F.coalesce(F.sum(r.price), F.lit(0)).alias("rev"), F.coalesce(F.sum(r.cost), F.lit(0)).alias("cst"))
    )
    out = agg.select(
        sub,
        F.col("rev").cast("double").alias("revenue"),
        F.col("cst").cast("double").alias("cogs"),
        (F.col("rev") - F.col("cst")).cast("double").alias("profit"),
    ).withColumn("profit_margin_pct", percent("profit", "revenue", 1))
    out = out.orderBy(*_desc_then(sub, "profit"))
    return out.limit(n) if n is not None else out


def _by_period(df: DataFrame, r: ColumnRoles, *keys) -> DataFrame:
    return (
        df.where(F.col(r.date).isNotNull())
        .groupBy(*keys)
        .agg(F.coalesce(F.sum(r.price), F.lit(0)).alias("rev"), F.coalesce(F.sum(r.cost), F.lit(0)).alias("cst"))
    )


def _profit_rows(sums: DataFrame, *keys) -> DataFrame:
    """Revenue, cost, profit and margin (2 digits) of ``(keys, rev, cst)`` rows."""
    return sums.select(
        *keys,
        F.col("rev").cast("double").alias("revenue"),
        F.col("cst").cast("double").alias("cost"),
        (F.col("rev") - F.col("cst")).cast("double").alias("profit"),
    ).withColumn("profit_margin", percent("profit", "revenue", 2))


def month_rows(sums: DataFrame) -> DataFrame:
    """MON-1 from ``(year, month, rev, cst)`` rows."""
    return _profit_rows(sums.where(F.col("rev") > 0), "year", "month", month_label("year", "month").alias("year_month"))


def quarter_rows(sums: DataFrame) -> DataFrame:
    """QTR-1 from ``(year, quarter, rev, cst)`` rows."""
    return _profit_rows(sums, "year", "quarter", quarter_label("year", "quarter").alias("year_quarter"))


def monthly_profit(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """MON-1: revenue, cost, profit, margin (2 digits) per month; months with revenue > 0."""
    r = roles_of(df, roles, "date", "price", "cost")
    return month_rows(_by_period(df, r, F.year(r.date).alias("year"), F.month(r.date).alias("month")))


def quarterly_profit(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """QTR-1: the same per quarter, without the revenue filter."""
    r = roles_of(df, roles, "date", "price", "cost")
    return quarter_rows(_by_period(df, r, F.year(r.date).alias("year"), F.quarter(r.date).alias("quarter")))


def period_profit(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """MON-1 and QTR-1 in one pass over the data: rows of grain ``month``
    (revenue > 0) and ``quarter``.  The data is aggregated to months once;
    the grouping sets run over those few rows, so no line is expanded."""
    r = roles_of(df, roles, "date", "price", "cost")
    d = F.col(r.date)
    months = _by_period(df, r, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"))
    both = months.groupingSets([[F.col("year"), F.col("quarter"), F.col("month")], [F.col("year"), F.col("quarter")]], "year", "quarter", "month")
    both = both.agg(F.sum("rev").alias("rev"), F.sum("cst").alias("cst"), F.grouping("month").alias("whole"))
    quarter = F.col("whole") == 1
    rows = both.where(quarter | (F.col("rev") > 0))
    return _profit_rows(
        rows,
        F.when(quarter, F.lit("quarter")).otherwise(F.lit("month")).alias("grain"),
        "year",
        F.when(quarter, F.col("quarter")).otherwise(F.col("month")).alias("period"),
        F.when(quarter, quarter_label("year", "quarter")).otherwise(month_label("year", "month")).alias("label"),
    )


def subcategory_sales(
    df: DataFrame,
    n: int | None = None,
    exclude_pattern: str | None = None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """CAT-1 / TOP-4 (and PRD-1 with ``exclude_pattern``): sales, count, average per subcategory."""
    r = roles_of(df, roles, "subcategory", "price")
    sub = r.subcategory
    src = df if exclude_pattern is None else df.where(~is_benefit(sub, exclude_pattern))
    out = (
        src.where(F.col(sub).isNotNull())
        .groupBy(sub)
        .agg(money_sum(r.price).alias("total_sales"), F.count(r.price).alias("transaction_count"))
        .withColumn("average_transaction", ratio("total_sales", "transaction_count"))
        .orderBy(*_desc_then(sub, "total_sales"))
    )
    return out.limit(n) if n is not None else out


def _with_hour(df: DataFrame, r: ColumnRoles) -> DataFrame:
    return df.where(F.col(r.date).isNotNull()).withColumn("hour", F.hour(r.date))


def _hourly(df: DataFrame, r: ColumnRoles) -> DataFrame:
    return (
        _with_hour(df, r)
        .groupBy("hour")
        .agg(
            money_sum(r.price).alias("total_sales"),
            F.count(r.price).alias("transaction_count"),
            mean(r.price).alias("avg_transaction"),
        )
    )


def _dayparts(df: DataFrame, r: ColumnRoles) -> DataFrame:
    return (
        _with_hour(df, r)
        .groupBy(daypart("hour").alias("time_period"))
        .agg(money_sum(r.price).alias("total_sales"), F.count(r.price).alias("transaction_count"))
    )


def hourly_sales(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """HR-1: sales, count and mean per hour, with day-part and ``HH:00`` labels."""
    r = roles_of(df, roles, "date", "price")
    return label_hours(_hourly(df, r))


def label_hours(hourly: DataFrame) -> DataFrame:
    """Day-part and ``HH:00`` labels for ``(hour, ...)`` rows, sorted by hour."""
    out = hourly.withColumn("time_period", daypart("hour")).withColumn("hour_display", hour_label("hour"))
    return _sorted_few(out, "hour")


def daypart_sales(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """HR-2: sales and count per day-part, by sales."""
    r = roles_of(df, roles, "date", "price")
    return _sorted_few(_dayparts(df, r), *_desc_then("time_period", "total_sales"))


def weekday_sales(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """DOW-1: sales and count per weekday, Monday (0) first."""
    r = roles_of(df, roles, "date", "price")
    d = F.col(r.date)
    out = (
        df.where(d.isNotNull())
        .groupBy(F.weekday(d).alias("day_num"))
        .agg(money_sum(r.price).alias("total_sales"), F.count(r.price).alias("transaction_count"))
        .select(weekday_label("day_num").alias("day_of_week"), "day_num", "total_sales", "transaction_count")
    )
    return _sorted_few(out, "day_num")


def peak_time(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """TOP-11: best hour (first on ties) with its count and mean, and the best day-part.

    No rows when there is no data.
    """
    r = roles_of(df, roles, "date", "price")
    # Exact (decimal) sums per hour; the day-part sums are sums of those, so
    # both arg-maxes compare the same exact values.
    hours = _with_hour(df, r).groupBy("hour").agg(
        F.coalesce(F.sum(r.price), F.lit(0)).alias("s"), F.count(r.price).alias("n")
    )
    return peak_from_hours(hours)


def peak_from_hours(hours: DataFrame) -> DataFrame:
    """TOP-11 from ``(hour, s, n)`` rows: exact sales sum and count per hour.
    The 24 rows become one array, from which both arg-maxes are taken."""
    kind = hours.schema["s"].dataType
    exact = f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"
    rows = hours.select(F.struct((-F.col("s")).cast(exact).alias("k"), "hour", "s", "n", daypart("hour").alias("p")).alias("r"))
    one = rows.agg(F.collect_list("r").alias("h")).where(F.size("h") > 0)
    zero = F.lit(0).cast(exact)
    periods = F.transform(
        F.array_distinct(F.transform("h", lambda x: x["p"])),
        lambda p: F.struct(
            F.aggregate(F.filter("h", lambda x: x["p"] == p), zero, lambda a, x: (a + x["k"]).cast(exact)).alias("k"),
            p.alias("p"),
        ),
    )
    best = one.select(F.array_min("h").alias("b"), F.array_min(periods).alias("q"))
    return best.select(
        F.col("b.hour").alias("best_hour"),
        F.format_string("%d:00", "b.hour").alias("best_hour_label"),
        F.col("b.s").cast("double").alias("best_hour_sales"),
        F.col("b.n").alias("peak_hour_transactions"),
        F.try_divide(F.col("b.s").cast("double"), F.col("b.n").cast("double")).alias("avg_per_transaction"),
        first_word(F.col("q.p")).alias("best_period"),
    )
