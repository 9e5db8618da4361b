"""Plan properties: JVM-only expressions, pushdown, top-k,
bounded broadcasts."""

import pytest

from conftest import SF_SMALL
from storelens.operators import filters as flt
from storelens.operators import products as prd
from storelens.operators import rollups as ru
from storelens.plans import inspect
from storelens.plans.catalog import QUERIES
from storelens.sources.star import purchases


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_no_cartesian(spark, name):
    inspect.assert_jvm_only(QUERIES[name](spark, SF_SMALL))


def test_date_filter_reaches_parquet(spark, scratch):
    path = f"{scratch}/purchases"
    purchases(spark, SF_SMALL).write.parquet(path)
    snap = spark.read.parquet(path)
    df = ru.sales_kpis(flt.date_range(snap, "1997-01-01", "1998-12-31"))
    pushed = " ".join(inspect.pushed_filters(df))
    assert "purchase_date" in pushed
    # only the two columns the KPI needs are read
    assert inspect.read_schemas(df) == ["struct<purchase_date:timestamp_ntz,purchase_price_w_discount:decimal(18,2)>"]


def test_top_k_is_take_ordered(spark):
    assert inspect.has_operator(ru.top_locations(purchases(spark, SF_SMALL)), "TakeOrderedAndProject")


def test_column_pruning_on_star_view(spark):
    schemas = " ".join(inspect.read_schemas(ru.hourly_sales(purchases(spark, SF_SMALL))))
    assert "l_shipdate" not in schemas and "p_size" not in schemas


def test_highlights_broadcast_only_bounded_lists(spark):
    text = inspect.plan_text(prd.product_highlights(purchases(spark, SF_SMALL), n=10, pattern="brand#25"))
    assert "BroadcastExchange" in text


@pytest.mark.parametrize("name", ["weekly_sales", "yoy_quarterly", "yoy_quarterly_long_profit", "peak_time", "vendor_concentration"])
def test_one_scan_of_the_fact(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # A reused exchange stands for the scan below it; the subquery's plan is shown apart.
    assert plan.count("lineitem.parquet") == 1 or "ReusedExchange" in plan, plan


def test_highlights_count_invoices_of_winners_only(spark):
    text = inspect.plan_text(prd.product_highlights(purchases(spark, SF_SMALL), n=10, pattern="brand#25"))
    # the wide key (product and invoice) is never shuffled on
    assert not [line for line in text.splitlines() if "hashpartitioning" in line and "p_name" in line and "l_orderkey" in line]


def test_long_lists_stay_in_the_scan(spark):
    text = inspect.plan_text(flt.in_locations(purchases(spark, SF_SMALL), [f"NATION_{i}" for i in range(5000)]))
    assert "INSET" in text or " IN (" in text or "In(" in text
