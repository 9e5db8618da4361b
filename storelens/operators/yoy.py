"""Year-to-date metrics, quarter pivot and year-over-year comparisons.

The heavy part of each operator is one grouped aggregation of the fact;
everything after it works on the handful of per-year / per-quarter rows.
The two latest years are found with a top-2 sort of those aggregated rows
(``TakeOrderedAndProject``), never with an unpartitioned window over data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import half_even, mean, money_sum, pct_change, percent
from ..functions.roles import ColumnRoles, roles_of
from .filters import year_to_date
from .rollups import quarterly_profit


def latest_two_years(agg: DataFrame, values: list[str], year: str = "year") -> DataFrame:
    """YOY-1: one row holding the latest and the previous year present.

    ``cur_<v>`` / ``prev_<v>`` for every value column; zero rows when fewer
    than two years exist.  The years need not be adjacent.
    """
    top2 = agg.orderBy(F.desc(year)).limit(2)
    cols = [F.count(F.lit(1)).alias("_n"), F.max(year).alias("cur_year"), F.min(year).alias("prev_year")]
    for v in values:
        cols += [F.max_by(v, year).alias(f"cur_{v}"), F.min_by(v, year).alias(f"prev_{v}")]
    return top2.agg(*cols).where(F.col("_n") == 2).drop("_n")


def ytd_metrics(df: DataFrame, as_of=None, roles: ColumnRoles | None = None) -> DataFrame:
    """YTD-1: per year, on the year-to-date rows: revenue, average price,
    count, cost, average cost (rounded to 2 first), then profit, margin (2)
    and profit per sale (2) from the rounded values."""
    r = roles_of(df, roles, "date", "price", "cost")
    ytd = year_to_date(df.where(F.col(r.date).isNotNull()), as_of, r)
    return (
        ytd.groupBy(F.year(r.date).alias("year"))
        .agg(
            half_even(money_sum(r.price), 2).alias("total_revenue"),
            half_even(mean(r.price), 2).alias("avg_sale_price"),
            F.count(r.price).alias("transaction_count"),
            half_even(money_sum(r.cost), 2).alias("total_cost"),
            half_even(mean(r.cost), 2).alias("avg_unit_cost"),
        )
        .transform(with_ytd_profit)
    )


def with_ytd_profit(metrics: DataFrame) -> DataFrame:
    """Profit, margin and profit per sale from the rounded YTD totals."""
    return (
        metrics.withColumn("total_profit", F.col("total_revenue") - F.col("total_cost"))
        .withColumn("profit_margin", percent("total_profit", "total_revenue", 2))
        .withColumn(
            "avg_profit_per_sale", half_even(F.try_divide("total_profit", F.col("transaction_count").cast("double")), 2)
        )
    )


def ytd_changes(df: DataFrame, as_of=None, roles: ColumnRoles | None = None) -> DataFrame:
    """YOY-4: % change latest vs. previous year of the YTD metrics."""
    return ytd_changes_from(ytd_metrics(df, as_of, roles))


def ytd_changes_from(metrics: DataFrame) -> DataFrame:
    """YOY-4 from an already computed YTD-1 table."""
    two = latest_two_years(
        metrics,
        ["total_revenue", "total_cost", "avg_sale_price", "avg_unit_cost", "transaction_count"],
    )
    return two.select(
        "prev_year",
        "cur_year",
        pct_change("cur_total_revenue", "prev_total_revenue").alias("revenue_change"),
        pct_change("cur_total_cost", "prev_total_cost").alias("cost_change"),
        pct_change("cur_avg_sale_price", "prev_avg_sale_price").alias("avg_price_change"),
        pct_change("cur_avg_unit_cost", "prev_avg_unit_cost").alias("avg_cost_change"),
        pct_change("cur_transaction_count", "prev_transaction_count").alias("transaction_change"),
    )


def quarter_year_pivot(
    df: DataFrame, value: str = "profit", years: list[int] | None = None, roles: ColumnRoles | None = None
) -> DataFrame:
    """PIV-1: quarter x year table of ``profit`` or ``profit_margin``; missing -> 0.

    With ``years`` the columns are those years.  Without, they are not known
    before the data is read: the cells come as a map from year to value, one
    for each quarter (``pivot_cells``).  Nothing runs until the result is used.
    """
    return pivot_quarters(quarterly_profit(df, roles), value, years)


def pivot_quarters(quarters: DataFrame, value: str = "profit", years: list[int] | None = None) -> DataFrame:
    """PIV-1 from QTR-1 rows."""
    if years is None:
        cells = pivot_cells(quarters, value)
        return cells.groupBy("quarter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "value")))).alias("by_year"))
    cells = [F.coalesce(F.max(F.when(F.col("year") == y, F.col(value))), F.lit(0.0)).alias(str(y)) for y in years]
    return quarters.groupBy("quarter").agg(*cells) if cells else quarters.select("quarter").distinct()


def pivot_cells(quarters: DataFrame, value: str = "profit") -> DataFrame:
    """PIV-1 in long form from QTR-1 rows, used once: (quarter, year, value) of
    every quarter present and every year present, missing -> 0.  The rows,
    four a year, become one array, from which the grid is filled."""
    one = quarters.agg(F.collect_list(F.struct("quarter", "year", F.col(value).alias("value"))).alias("cells"))
    several = lambda c: F.array_distinct(F.transform("cells", lambda x: x[c]))
    grid = one.select("cells", several("year").alias("years"), F.explode(several("quarter")).alias("quarter"))
    grid = grid.select("cells", "quarter", F.explode("years").alias("year"))
    here = F.filter("cells", lambda x: (x["quarter"] == F.col("quarter")) & (x["year"] == F.col("year")))
    found = F.try_element_at(F.transform(here, lambda x: x["value"]), F.lit(1))
    return grid.select("quarter", "year", F.coalesce(found, F.lit(0.0)).alias("value"))


def yoy_quarterly(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """YOY-2: Q1..Q4 profit and margin of the two latest years, with changes.

    Always four rows (missing quarters are 0) when two years exist, else
    none.  Change % is rounded to 1 digit; infinite or undefined values are
    0.  A margin cell over zero revenue is 0; if it stood for +/-inf (profit
    not 0) the margin change is 0 too, as in the reference.
    """
    return yoy_quarterly_from(quarterly_profit(df, roles))


def yoy_quarterly_from(quarters: DataFrame) -> DataFrame:
    """YOY-2 from QTR-1 rows, used once: the rows (four a year) become one
    array, from which the two latest years' cells are taken."""
    cell = F.struct("year", "quarter", "profit", "profit_margin", ((F.col("revenue") == 0) & (F.col("profit") != 0)).alias("inf"))
    one = quarters.select(cell.alias("c")).agg(F.collect_list("c").alias("cells"))
    one = one.withColumn("years", F.sort_array(F.array_distinct(F.transform("cells", lambda c: c["year"])), asc=False))
    grid = one.where(F.size("years") >= 2).select(
        F.element_at("years", 2).alias("prev_year"),
        F.element_at("years", 1).alias("cur_year"),
        "cells",
        F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("quarter"),
    )
    at = lambda y: F.try_element_at(
        F.filter("cells", lambda c: (c["year"] == F.col(y)) & (c["quarter"] == F.col("quarter"))), F.lit(1)
    )
    both = grid.select("quarter", "prev_year", "cur_year", at("prev_year").alias("p"), at("cur_year").alias("c"))
    t = both.select(
        F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("quarter"),
        "prev_year",
        "cur_year",
        F.coalesce("p.profit", F.lit(0.0)).alias("prev_profit"),
        F.coalesce("c.profit", F.lit(0.0)).alias("cur_profit"),
        F.coalesce("p.profit_margin", F.lit(0.0)).alias("prev_margin"),
        F.coalesce("c.profit_margin", F.lit(0.0)).alias("cur_margin"),
        (F.coalesce("p.inf", F.lit(False)) | F.coalesce("c.inf", F.lit(False))).alias("_inf"),
    )
    return t.select(
        "quarter",
        "prev_year",
        "cur_year",
        "prev_profit",
        "cur_profit",
        "prev_margin",
        "cur_margin",
        (F.col("cur_profit") - F.col("prev_profit")).alias("profit_change"),
        F.coalesce(half_even(pct_change("cur_profit", "prev_profit"), 1), F.lit(0.0)).alias("profit_change_pct"),
        F.when(F.col("_inf"), F.lit(0.0)).otherwise(F.col("cur_margin") - F.col("prev_margin")).alias("margin_change"),
    )


def yoy_quarterly_long(df: DataFrame, metric: str = "profit", roles: ColumnRoles | None = None) -> DataFrame:
    """YOY-3: long form of YOY-2 for grouped bars: (quarter, year, value) x 8."""
    if metric not in ("profit", "margin"):
        raise ValueError("metric must be 'profit' or 'margin'")
    return yoy_long_from(yoy_quarterly(df, roles), metric)


def yoy_long_from(w: DataFrame, metric: str = "profit") -> DataFrame:
    """YOY-3 from YOY-2 rows."""
    pairs = F.array(
        F.struct(F.col("prev_year").cast("string").alias("year"), F.col(f"prev_{metric}").alias("value")),
        F.struct(F.col("cur_year").cast("string").alias("year"), F.col(f"cur_{metric}").alias("value")),
    )
    return w.select("quarter", F.inline(pairs))


def yoy_readiness(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """INS-7: whether the year-over-year sections have enough data: at least
    two months with revenue > 0 and at least two years.  One row; the YoY
    operators themselves return zero rows below their own thresholds."""
    r = roles_of(df, roles, "date", "price")
    d = F.col(r.date)
    months = (
        df.where(d.isNotNull())
        .groupBy(F.year(d).alias("year"), F.month(d).alias("month"))
        .agg(F.coalesce(F.sum(r.price), F.lit(0)).alias("rev"))
    )
    return months.agg(
        F.count(F.when(F.col("rev") > 0, F.lit(1))).alias("months_with_revenue"),
        F.count_distinct("year").alias("years"),
    ).select(
        "months_with_revenue",
        "years",
        ((F.col("months_with_revenue") >= 2) & (F.col("years") >= 2)).alias("ready"),
    )
