"""Registered queries: each reads the test tables of one scale directory,
derives the purchases fact and runs one operator over all of it.

``QUERIES[name](spark, sf_dir) -> DataFrame``; the DuckDB twin of each lives
in :mod:`storelens.plans.oracles` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import is_benefit, money_text, parse_money
from ..operators import benefits as ben
from ..operators import calendar as cal
from ..operators import filters as flt
from ..operators import insights as ins
from ..operators import products as prd
from ..operators import rollups as ru
from ..operators import sketches as sk
from ..operators import vendors as ven
from ..operators import yoy
from ..functions import constants as K
from ..session import scratch, shuffles_freed
from ..sources import cache, clean, publish, readers
from . import dashboard
from ..sources.star import checkins, fact, input_bytes, partitions

Query = Callable[[SparkSession, str], DataFrame]

# Stand-ins on the star-schema fixture (FIXTURES.md §A): the benefit
# subcategory pattern and the category analysed against it.
FIXTURE_PATTERN = "brand#25"
FIXTURE_CATEGORY = "STANDARD"
FIXTURE_LOCATIONS = ["NATION_3", "NATION_7", "NATION_11"]
FIXTURE_CATEGORIES = ["STANDARD", "SMALL"]
FIXTURE_SUBCATEGORIES = ["Brand#1", "Brand#2", "Brand#25"]
FIXTURE_RANGE = ("1997-01-01", "1998-12-31")


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir)


def _pn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir, nulls=True)


def _on(fact, op, **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(fact(spark, sf_dir), **kw)

    q.__name__ = op.__name__
    return q


def _filtered(fact, flt_fn, op=ru.sales_kpis, **kw) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(flt_fn(fact(spark, sf_dir), **kw))

    q.__name__ = f"{op.__name__}_after_{flt_fn.__name__}"
    return q


def _default_view(df: DataFrame) -> DataFrame:
    """The dashboard's opening state: all time (midnight end bound), the
    first five locations and the first five categories."""
    return dashboard.apply(df, dashboard.FilterState())


def _category_scope(df: DataFrame) -> DataFrame:
    return flt.in_categories(df, flt.default_selection(df, "category"))


def _subcategory_filter(df: DataFrame) -> DataFrame:
    v = flt.in_categories(df, FIXTURE_CATEGORIES)
    return flt.in_subcategories(v, FIXTURE_SUBCATEGORIES, FIXTURE_CATEGORIES)


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p(spark, sf_dir)
    return ru.scope_summary(_category_scope(p), p)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.selected_categories(_category_scope(_p(spark, sf_dir)))


def _benefit_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _p(spark, sf_dir)
    return ins.benefit_insights(p, original=p, pattern=FIXTURE_PATTERN)


def _benefit_status_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INS-6 on a selection without benefit lines (all but the benefit brand)."""
    p = _p(spark, sf_dir)
    scoped = flt.in_categories(p, ["STANDARD", "SMALL"])
    return ins.benefit_status(scoped.where(~is_benefit("revenue_subcategory", FIXTURE_PATTERN)), p, FIXTURE_PATTERN)


def _text_purchases(df: DataFrame) -> DataFrame:
    """The fact as an exported sheet would hold it: padded names, dates and
    prices as text (cost too, which the name rule must leave alone)."""
    return df.select(
        F.date_format("purchase_date", "yyyy-MM-dd HH:mm:ss").alias(" purchase_date "),
        F.col(K.INVOICE).alias(f"{K.INVOICE} "),
        F.concat(F.lit(" "), F.col(K.PRICE).cast("string"), F.lit(" ")).alias(K.PRICE),
        F.col(K.COST).cast("string").alias(K.COST),
    )


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact's own columns, for queries that return or hash all of them."""
    return fact(spark, sf_dir, months=False)


def _dirty_text(df: DataFrame) -> DataFrame:
    """The fact as text in the date forms that exports hold, some of it bad."""
    d, k = F.col("purchase_date"), F.col(K.INVOICE) % 8
    form = lambda pattern: F.date_format(d, pattern)
    dates = [
        form("yyyy-MM-dd HH:mm:ss"), form("M/d/yyyy"), form("M/d/yyyy H:mm"), form("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        form("yyyy/MM/dd"), form("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("no date"), form("yyyy-MM-dd HH:mm"),
    ]
    price = F.col(K.PRICE).cast("string")
    prices = [price, F.lit("nan"), F.concat(F.lit("$"), price), F.lit("2d"), F.concat(F.lit(" "), price, F.lit(" ")), F.lit("Infinity"), F.lit("")]
    pick = lambda values, key: F.element_at(F.array(*values), (key + 1).cast("int"))
    return df.select(
        F.col(K.INVOICE), pick(dates, k).alias(" purchase_date"), pick(prices, F.col(K.INVOICE) % 7).alias(f"{K.PRICE} ")
    )


def _dirty_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned dirty text, by date form: rows, parsed dates and their extent, parsed prices and their sum."""
    c = clean.preprocess(_dirty_text(_plain(spark, sf_dir)))
    return c.groupBy((F.col(K.INVOICE) % 8).alias("form")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("purchase_date").alias("dates"),
        F.min("purchase_date").alias("first_date"),
        F.max("purchase_date").alias("last_date"),
        F.count(K.PRICE).alias("prices"),
        F.sum(F.round(F.col(K.PRICE) * 100).cast("bigint")).alias("cents"),
    )


def _dirty_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.parse_losses(_dirty_text(_plain(spark, sf_dir)))


def _publish_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a later version of the fact adds and removes."""
    old = _plain(spark, sf_dir)
    raised = F.when(F.col(K.INVOICE) % 60 == 1, F.col(K.QUANTITY) + 1).otherwise(F.col(K.QUANTITY))
    new = old.where(F.col(K.INVOICE) % 50 != 0).withColumn(K.QUANTITY, raised)
    return publish.diff(old, new)


def _first_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1..4 on the test folder itself: no table is named like purchases, so the first one is read."""
    return readers.read_sales(spark, [f"{sf_dir}/absent", sf_dir])[0]


def _publish_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the fact published three times to one place: first, again in
    another order, and changed; what each step wrote, read back from there.

    The fact is derived once, into a folder of its own: publishing passes over
    its rows several times, each of which would repeat the joins.  It is written
    part by part, so that the joins' shuffles of one part are gone before the
    next begins, and removed when the last step is published."""
    target, derived = scratch(spark, "published"), scratch(spark, "to-publish")
    with shuffles_freed(spark):
        n = publish.part_count(input_bytes(spark, sf_dir), publish.MOVED_PARTS)
        for part in publish.parts(_plain(spark, sf_dir), n, [K.INVOICE]):
            part.write.mode("append").parquet(derived)
    p = spark.read.parquet(derived)
    raised = F.when(F.col(K.INVOICE) % 60 == 1, F.col(K.QUANTITY) + 1).otherwise(F.col(K.QUANTITY))
    changed = p.where(F.col(K.INVOICE) % 50 != 0).withColumn(K.QUANTITY, raised)
    steps = []
    for step, rows in (("first", p), ("same rows", p.repartition(F.col(K.PRODUCT))), ("changed", changed)):
        new = publish.publish_if_changed(rows, target)
        version, path = publish.versions(spark, target)[-1]
        read = spark.read.parquet(path).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(K.QUANTITY).alias("quantity"), F.sum(K.PRICE).cast("double").alias("sales")
        )
        steps.append(read.select(F.lit(step).alias("step"), F.lit(new).alias("written"), F.lit(version).alias("version"), "rows", "quantity", "sales"))
    readers._FS(spark, derived).delete()
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def _sheets(spark: SparkSession, sf_dir: str, purchases_readable: bool = True) -> str:
    """A folder of exported sheets: one of all lines, a check-in sheet and a
    purchases sheet (without being readable: text under a table's name)."""
    folder = scratch(spark, "sheets")
    p = _plain(spark, sf_dir)
    if purchases_readable:
        spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{folder}/A summary")
        p.write.parquet(f"{folder}/Purchases 2024")
    else:
        p.write.parquet(f"{folder}/All lines")
        spark.range(3).select(F.col("id").cast("string")).write.text(f"{folder}/Purchases 2024")
    checkins(spark, sf_dir).write.parquet(f"{folder}/Checkins")
    return folder


def _sheet_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1..3: the first folder that exists, the sheet named like purchases."""
    folder = _sheets(spark, sf_dir)
    return readers.read_source(spark, [f"{folder}/absent", folder, sf_dir]).purchases


def _sheet_checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-6: the check-in sheet of the same folder, cleaned."""
    return clean.preprocess(readers.read_source(spark, _sheets(spark, sf_dir)).checkins)


def _sheet_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4: the sheet named like purchases cannot be read, so the first one is."""
    return readers.read_source(spark, _sheets(spark, sf_dir, purchases_readable=False)).purchases


def _catalog_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2 over a database of the session's catalog: its tables are the sheets of a folder."""
    folder = _sheets(spark, sf_dir)
    database = "sales_" + folder.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}-database'")
    for t in readers.list_tables(spark, folder):
        spark.catalog.createTable(f"{database}.{t.name.lower().replace(' ', '_')}", path=t.path, source="parquet")
    return readers.read_source(spark, ["catalog:no_such_database", f"{readers.CATALOG}{database}"]).purchases


def _snapshot_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: orders per year kept as a snapshot of a folder: built, read again
    as it was, and built anew after a file was added to the folder."""
    folder = scratch(spark, "orders")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.write.parquet(folder)

    def per_year(target: str) -> None:
        rows = spark.read.parquet(folder).groupBy(F.year("o_orderdate").alias("year"))
        rows.agg(F.count(F.lit(1)).alias("orders")).write.parquet(target)

    calls = []
    for call in (1, 2, 3):
        if call == 3:
            orders.where(F.col("o_orderkey") % 10 == 0).write.mode("append").parquet(folder)
        kept = cache.snapshot(spark, "orders-per-year", cache.inputs(spark, [folder]).key, per_year)
        calls.append(kept.df.select(F.lit(call).alias("call"), F.lit(kept.built).alias("built"), "year", "orders"))
    return calls[0].unionByName(calls[1]).unionByName(calls[2])


def _long_list_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3 with a selection of 100,003 values."""
    values = [*FIXTURE_LOCATIONS, *(f"STORE_{i}" for i in range(100_000))]
    return ru.sales_kpis(flt.in_locations(_p(spark, sf_dir), values))


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEN-1 from day sketches beside the exact counts, with the errors in percent."""
    p = _p(spark, sf_dir)
    est = sk.penetration_from_sketches(sk.day_sketches(p, FIXTURE_PATTERN))
    exact = ben.benefit_penetration(p, FIXTURE_PATTERN)
    both = est.alias("e").join(exact.alias("x"), "year")
    error = lambda c: F.abs(F.try_divide(F.col(f"e.{c}").cast("double"), F.col(f"x.{c}").cast("double")) - 1) * 100
    return both.select(
        "year", "e.total_invoices", "e.benefit_invoices", "e.penetration_rate",
        error("total_invoices").alias("total_error_pct"), error("benefit_invoices").alias("benefit_error_pct"),
    )


def _sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PEN-1: exact counts, and whether the sketches' lie within four standard errors of them."""
    p = _p(spark, sf_dir)
    est = sk.penetration_from_sketches(sk.day_sketches(p, FIXTURE_PATTERN)).select(
        "year", F.col("total_invoices").alias("et"), F.col("benefit_invoices").alias("eb")
    )
    both = ben.benefit_penetration(p, FIXTURE_PATTERN).join(est, "year")
    return both.select("year", "total_invoices", "benefit_invoices", sk.within("et", "total_invoices").alias("total_within"), sk.within("eb", "benefit_invoices").alias("benefit_within"))


def _product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prd.product_stats(_p(spark, sf_dir), partitions=partitions(spark, sf_dir))


def _product_sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRD-2 from month sketches: exact sums and invoices, and whether the sketches' count lies within four standard errors."""
    p = _p(spark, sf_dir)
    keys = [K.SUBCATEGORY, K.PRODUCT]
    est = sk.product_stats_from_sketches(sk.product_sketches(p)).withColumnRenamed("unique_transactions", "estimate")
    exact = prd.product_stats(p, partitions=partitions(spark, sf_dir)).select(*keys, "unique_transactions")
    return est.join(exact, keys).select(*keys, "total_quantity", "total_sales", "avg_price", "unique_transactions", sk.within("estimate", "unique_transactions").alias("within"))


def _wide_pivot(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return dashboard.wide_pivot(ru.quarterly_profit(_p(spark, sf_dir)), value)


def _pivot_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIV-1 as a map from year to value, its entries listed as text."""
    t = yoy.quarter_year_pivot(_p(spark, sf_dir), "profit")
    entries = F.transform(F.map_entries("by_year"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string")))
    return t.select("quarter", F.array_join(entries, ",").alias("cents_by_year"))


def _money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14 and PRJ-15: sales as dollar text, and the text read back."""
    t = ru.subcategory_sales(_p(spark, sf_dir)).select(K.SUBCATEGORY, money_text("total_sales", 0).alias("sales_text"))
    return t.withColumn("sales", parse_money("sales_text"))


def _benefit_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INS-6 where the selection holds the focus category but not the benefit's home."""
    p = _p(spark, sf_dir)
    one = flt.in_categories(p, [FIXTURE_CATEGORY])
    return ins.benefit_status(
        one.where(~is_benefit("revenue_subcategory", FIXTURE_PATTERN)), p, FIXTURE_PATTERN, category=FIXTURE_CATEGORY, home_category="SMALL"
    )


def _preprocess_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.preprocess(_text_purchases(_plain(spark, sf_dir)))


def _canonical_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fact as an all-text export, cleaned and cast back to the
    canonical role schema: must equal the fact itself."""
    p = _plain(spark, sf_dir)
    text = p.select([F.col(c).cast("string").alias(c) for c in p.columns])
    return clean.canonical(clean.preprocess(text))


def _checkins_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.preprocess(checkins(spark, sf_dir))


def _via_cube(fact_fn, derive, **kw) -> Query:
    """The same result as the operator, derived from the calendar cube."""

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derive(cal.calendar_cube(fact_fn(spark, sf_dir), pattern=FIXTURE_PATTERN), **kw)

    q.__name__ = derive.__name__
    return q


B = {"pattern": FIXTURE_PATTERN}
BC = {"pattern": FIXTURE_PATTERN, "category": FIXTURE_CATEGORY}

QUERIES: dict[str, Query] = {
    # sources, cleaning, sinks
    "preprocess_roundtrip": _preprocess_roundtrip,
    "canonical_roundtrip": _canonical_roundtrip,
    "checkins_clean": _checkins_clean,
    "sample_rows": _on(_plain, publish.sample_rows, n=100),
    "fingerprint": _on(_plain, publish.fingerprint),
    "fingerprint_columns": _on(_plain, publish.column_digests),
    "dirty_purchases": _dirty_purchases,
    "dirty_losses": _dirty_losses,
    "publish_diff": _publish_diff,
    "source_first_table": _first_table,
    "publish_cycle": _publish_cycle,
    "sheet_purchases": _sheet_purchases,
    "sheet_checkins": _sheet_checkins,
    "sheet_fallback": _sheet_fallback,
    "catalog_purchases": _catalog_purchases,
    "snapshot_reuse": _snapshot_reuse,
    "money_labels": _money_labels,
    # KPIs and extents
    "sales_kpis": _on(_p, ru.sales_kpis),
    "sales_kpis_nulls": _on(_pn, ru.sales_kpis),
    "profit_kpis": _on(_p, ru.profit_kpis),
    "date_extent": _on(_p, flt.date_extent),
    "scope_summary": _scope,
    "selected_categories": _selected,
    # filters and filter options
    "location_options": _on(_p, flt.filter_options, role="location"),
    "category_options": _on(_p, flt.filter_options, role="category"),
    "subcategory_options": _on(_p, flt.filter_options, role="subcategory", within=FIXTURE_CATEGORIES),
    "default_location_selection": _on(_p, flt.default_selection, role="location"),
    "default_category_selection": _on(_p, flt.default_selection, role="category"),
    "date_range_kpis": _filtered(_p, flt.date_range, start=FIXTURE_RANGE[0], end=FIXTURE_RANGE[1]),
    "date_range_day_kpis": _filtered(
        _p, flt.date_range, start=FIXTURE_RANGE[0], end=FIXTURE_RANGE[1], end_inclusive="day"
    ),
    "all_time_kpis": _filtered(_p, flt.all_time),
    "last_30_days_kpis": _filtered(_p, flt.last_n_days, n=30),
    "last_90_days_kpis": _filtered(_p, flt.last_n_days, n=90),
    "location_filter_kpis": _filtered(_p, flt.in_locations, values=FIXTURE_LOCATIONS),
    "location_long_list_kpis": _long_list_kpis,
    "category_filter_kpis": _filtered(_p, flt.in_categories, values=FIXTURE_CATEGORIES),
    "subcategory_filter_kpis": _filtered(_p, _subcategory_filter),
    "default_view_kpis": _filtered(_p, _default_view),
    "default_view_profit_kpis": _filtered(_p, _default_view, op=ru.profit_kpis),
    "year_to_date_kpis": _filtered(_p, flt.year_to_date),
    "ytd_window": _on(_p, flt.ytd_window),
    "yoy_readiness": _on(_p, yoy.yoy_readiness),
    # flat rollups
    "weekly_sales": _on(_p, ru.weekly_sales),
    "weekly_sales_by_location": _on(_p, ru.weekly_sales, by_location=True),
    "weekly_sales_by_location_nulls": _on(_pn, ru.weekly_sales, by_location=True),
    "top_locations": _on(_p, ru.top_locations, n=10),
    "profit_by_subcategory": _on(_p, ru.profit_by_subcategory),
    "profit_by_subcategory_top15": _on(_p, ru.profit_by_subcategory, n=15),
    "monthly_profit": _on(_p, ru.monthly_profit),
    "monthly_profit_nulls": _on(_pn, ru.monthly_profit),
    "quarterly_profit": _on(_p, ru.quarterly_profit),
    "period_profit": _on(_p, ru.period_profit),
    "subcategory_sales": _on(_p, ru.subcategory_sales),
    "subcategory_sales_top10": _on(_p, ru.subcategory_sales, n=10),
    "subcategory_sales_nulls": _on(_pn, ru.subcategory_sales),
    "subcategory_sales_ex_benefit": _on(_p, ru.subcategory_sales, exclude_pattern=FIXTURE_PATTERN),
    "hourly_sales": _on(_p, ru.hourly_sales),
    "daypart_sales": _on(_p, ru.daypart_sales),
    "weekday_sales": _on(_p, ru.weekday_sales),
    "peak_time": _on(_p, ru.peak_time),
    # year to date, pivot, year over year
    "ytd_metrics": _on(_p, yoy.ytd_metrics),
    "ytd_changes": _on(_p, yoy.ytd_changes),
    "quarter_year_pivot_profit": lambda s, d: _wide_pivot(s, d, "profit"),
    "quarter_year_pivot_margin": lambda s, d: _wide_pivot(s, d, "profit_margin"),
    "quarter_year_cells": lambda s, d: yoy.pivot_cells(ru.quarterly_profit(_p(s, d)), "profit_margin"),
    "quarter_year_map": _pivot_map,
    "yoy_quarterly": _on(_p, yoy.yoy_quarterly),
    "yoy_quarterly_long_profit": _on(_p, yoy.yoy_quarterly_long, metric="profit"),
    "yoy_quarterly_long_margin": _on(_p, yoy.yoy_quarterly_long, metric="margin"),
    "profitability_insights": _on(_p, ins.profitability_insights),
    # member benefits
    "benefit_ytd": _on(_p, ben.benefit_ytd, **B),
    "benefit_monthly": _on(_p, ben.benefit_monthly, **B),
    "benefit_changes": _on(_p, ben.benefit_changes, **B),
    "benefit_revenue_share": _on(_p, ben.benefit_revenue_share, **B),
    "benefit_insights": _benefit_insights,
    "benefit_status_scoped": _benefit_status_scoped,
    "benefit_status_hint": _benefit_hint,
    "benefit_penetration": _on(_p, ben.benefit_penetration, **B),
    "benefit_penetration_nulls": _on(_pn, ben.benefit_penetration, **B),
    "benefit_penetration_sketched": _sketched,
    "penetration_sketch_bounds": _sketch_bounds,
    "penetration_changes": _on(_p, ben.penetration_changes, **B),
    "penetration_insights": _on(_p, ins.penetration_insights, **B),
    "category_with_benefit": _on(_p, ben.category_with_benefit, **BC),
    "category_ytd": _on(_p, ben.category_ytd, category=FIXTURE_CATEGORY),
    "category_benefit_penetration": _on(_p, ben.category_benefit_penetration, **BC),
    "category_penetration_change": _on(_p, ben.category_penetration_change, **BC),
    "category_insights": _on(_p, ins.category_insights, **BC),
    # products
    "product_stats": _product_stats,
    "product_sketch_bounds": _product_sketch_bounds,
    "product_highlights": _on(_p, prd.product_highlights, **B),
    "product_highlights_nulls": _on(_pn, prd.product_highlights, **B),
    "highlight_leaders": _on(_p, prd.highlight_leaders, **B),
    # vendors
    "vendor_performance": _on(_p, ven.vendor_performance),
    "vendor_performance_nulls": _on(_pn, ven.vendor_performance),
    "vendor_concentration": _on(_p, ven.vendor_concentration),
    "vendor_concentration_nulls": _on(_pn, ven.vendor_concentration),
    "top_vendors_by_sales": _on(_p, ven.top_vendors, by="total_sales", n=15),
    "top_vendors_by_count": _on(_p, ven.top_vendors, by="transaction_count", n=15),
    "top_vendors_by_profit": _on(_p, ven.top_vendors, by="profit", n=15),
    "top_vendors_by_margin": _on(_p, ven.top_vendors, by="profit_margin", n=15, min_txns=10),
    "top_vendors_by_avg": _on(_p, ven.top_vendors, by="avg_transaction", n=15, min_txns=5),
    "vendor_scatter": _on(_p, ven.top_vendors, by="total_sales", n=20),
    "vendor_detail": _on(_p, ven.vendor_detail, n=30),
    # calendar cube: the date-keyed sections from one (day, hour) aggregate
    "sales_kpis_via_cube": _via_cube(_p, cal.sales_kpis_from_cube),
    "sales_kpis_nulls_via_cube": _via_cube(_pn, cal.sales_kpis_from_cube),
    "profit_kpis_via_cube": _via_cube(_p, cal.profit_kpis_from_cube),
    "weekly_sales_via_cube": _via_cube(_p, cal.weekly_sales_from_cube),
    "monthly_profit_via_cube": _via_cube(_p, cal.monthly_profit_from_cube),
    "monthly_profit_nulls_via_cube": _via_cube(_pn, cal.monthly_profit_from_cube),
    "quarterly_profit_via_cube": _via_cube(_p, cal.quarterly_profit_from_cube),
    "hourly_sales_via_cube": _via_cube(_p, cal.hourly_sales_from_cube),
    "daypart_sales_via_cube": _via_cube(_p, cal.daypart_sales_from_cube),
    "weekday_sales_via_cube": _via_cube(_p, cal.weekday_sales_from_cube),
    "peak_time_via_cube": _via_cube(_p, cal.peak_time_from_cube),
    "ytd_metrics_via_cube": _via_cube(_p, cal.ytd_metrics_from_cube),
    "ytd_changes_via_cube": _via_cube(_p, cal.ytd_changes_from_cube),
    "benefit_ytd_via_cube": _via_cube(_p, cal.benefit_ytd_from_cube),
    "benefit_monthly_via_cube": _via_cube(_p, cal.benefit_monthly_from_cube),
    "benefit_changes_via_cube": _via_cube(_p, cal.benefit_changes_from_cube),
    "benefit_revenue_share_via_cube": _via_cube(_p, cal.benefit_revenue_share_from_cube),
}
