"""The materialized fact table gives the same answers as the lazy view."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from storelens.plans.catalog import QUERIES
from storelens.sources import publish
from storelens.sources.star import MATERIALIZE_CONF, purchases, purchases_table


def test_table_equals_view(spark):
    view = purchases(spark, SF_SMALL)
    table = purchases_table(spark, SF_SMALL)
    assert table.schema == view.schema
    assert publish.multiset_equal(table, view)
    # second call reuses the written table
    assert purchases_table(spark, SF_SMALL).inputFiles() == table.inputFiles()


@pytest.mark.parametrize("name", ["weekly_sales", "benefit_penetration_nulls", "product_highlights",
                                  "vendor_concentration", "yoy_quarterly", "default_view_kpis"])
def test_queries_same_on_table(spark, name):
    q = QUERIES[name]
    spark.conf.set(MATERIALIZE_CONF, "false")
    lazy = q(spark, SF_SMALL)
    spark.conf.set(MATERIALIZE_CONF, "true")
    try:
        mat = q(spark, SF_SMALL)
        assert publish.multiset_equal(lazy, mat)
    finally:
        spark.conf.set(MATERIALIZE_CONF, "false")


def test_date_filter_pushed_on_table(spark):
    from storelens.operators import filters as flt
    from storelens.plans import inspect

    t = flt.date_range(purchases_table(spark, SF_SMALL), "1998-01-01", "1998-03-31")
    assert "purchase_date" in " ".join(inspect.pushed_filters(t))
    assert t.where(F.col("purchase_date") > F.lit("1998-03-31").cast("timestamp_ntz")).count() == 0


def test_changed_input_gets_a_new_table(spark, scratch):
    from storelens.sources import star

    src = f"{scratch}/tables"
    for name in star._INPUTS:
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{src}/{name}.parquet")
    k1 = star._input_key(spark, src)
    spark.conf.set(MATERIALIZE_CONF, "true")
    try:
        n1 = star.fact(spark, src).count()
        # rewrite one input with a row fewer
        orders = spark.read.parquet(f"{src}/orders.parquet")
        first = orders.orderBy("o_orderkey").limit(1)
        orders.exceptAll(first).write.mode("overwrite").parquet(f"{scratch}/orders_tmp")
        spark.read.parquet(f"{scratch}/orders_tmp").write.mode("overwrite").parquet(f"{src}/orders.parquet")
        assert star._input_key(spark, src) != k1
        assert star.fact(spark, src).count() < n1
    finally:
        spark.conf.set(MATERIALIZE_CONF, "false")


def test_unfinished_build_is_not_read(spark, scratch):
    import os

    from storelens.session import shared_dir
    from storelens.sources import star

    src = f"{scratch}/tables"
    for name in star._INPUTS:
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{src}/{name}.parquet")
    base = f"{shared_dir(spark)}/storelens/purchases/{star._input_key(spark, src)}"
    os.makedirs(f"{base}/data-0/purchase_month=1995-01-01")
    assert publish.multiset_equal(purchases_table(spark, src), purchases(spark, src))


@pytest.fixture
def in_months(spark):
    """Facts of any size are written in a folder a month."""
    from storelens.sources.star import MONTH_BYTES_CONF

    spark.conf.set(MONTH_BYTES_CONF, "0")
    yield
    spark.conf.unset(MONTH_BYTES_CONF)


def test_date_windows_skip_months(spark, in_months):
    from storelens.operators import filters as flt

    t = purchases_table(spark, SF_SMALL, months=True)
    everything = len(t.inputFiles())
    for v in (flt.last_n_days(t, 30), flt.date_range(t, "1998-01-01", "1998-03-31"), flt.year_to_date(t, "1998-02-10")):
        rows = v.select("purchase_date")
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert any("purchase_month" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    march = flt.date_range(t, "1998-01-01", "1998-03-31")
    assert {r[0] for r in march.selectExpr("date_format(purchase_month, 'yyyy-MM')").distinct().collect()} <= {"1998-01", "1998-02", "1998-03"}
    assert everything > 12


def test_preset_lower_bound_is_pushed(spark):
    from storelens.operators import filters as flt
    from storelens.plans import inspect

    pushed = " ".join(inspect.pushed_filters(flt.last_n_days(purchases_table(spark, SF_SMALL), 30)))
    assert "GreaterThanOrEqual(purchase_date" in pushed
