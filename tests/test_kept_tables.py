"""Snapshots, catalog sources, the shared folder, long selections, sketches, pivots."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import ROOT, SF_SMALL
from storelens.functions import constants as K
from storelens.operators import benefits as ben
from storelens.operators import filters as flt
from storelens.operators import products as prd
from storelens.operators import rollups as ru
from storelens.operators import sketches as sk
from storelens.operators import yoy
from storelens.plans import inspect
from storelens.session import scratch as fresh
from storelens.session import shared_dir
from storelens.sources import cache, readers
from storelens.sources.star import MONTH_BYTES_CONF, purchases, purchases_table

PATTERN = "brand#25"


@pytest.fixture(scope="module")
def p(spark):
    return purchases(spark, SF_SMALL).cache()


def _copy(spark, folder, rows=10):
    spark.range(rows).write.mode("append").parquet(folder)


def test_snapshot_is_built_once_and_anew_for_changed_inputs(spark, scratch):
    src, builds = f"{scratch}/in", []
    _copy(spark, src)

    def write(target):
        builds.append(target)
        spark.read.parquet(src).write.parquet(target)

    def call():
        return cache.snapshot(spark, "test", cache.inputs(spark, [src]).key, write)

    one, two = call(), call()
    assert (one.built, two.built) == (True, False) and len(builds) == 1
    assert two.df.count() == 10
    _copy(spark, src, 5)
    three = call()
    assert three.built and three.df.count() == 15 and len(builds) == 2


def test_unfinished_snapshot_is_not_read(spark, scratch):
    src = f"{scratch}/in"
    _copy(spark, src)
    key = cache.inputs(spark, [src]).key
    os.makedirs(f"{shared_dir(spark).removeprefix('file:')}/storelens/test/{key}/data-0")
    assert cache.snapshot(spark, "test", key, lambda t: spark.read.parquet(src).write.parquet(t)).df.count() == 10


def test_failed_build_leaves_no_snapshot(spark, scratch):
    src = f"{scratch}/in"
    _copy(spark, src)
    key = cache.inputs(spark, [src]).key

    def broken(target):
        raise OSError("lost")

    with pytest.raises(OSError):
        cache.snapshot(spark, "test", key, broken)
    assert cache.snapshot(spark, "test", key, lambda t: spark.read.parquet(src).write.parquet(t)).built


def test_inputs_by_driver_and_by_job_see_changes(spark, scratch, monkeypatch):
    src = f"{scratch}/in"
    _copy(spark, src)
    for listed in (cache.LISTED_FILES, 0):
        monkeypatch.setattr(cache, "LISTED_FILES", listed)
        before = cache.inputs(spark, [src])
        assert before == cache.inputs(spark, [src]) and before.bytes > 0
        _copy(spark, src, 3)
        after = cache.inputs(spark, [src])
        assert after.key != before.key and after.bytes > before.bytes


def test_small_facts_are_not_cut_by_month(spark):
    spark.conf.set(MONTH_BYTES_CONF, str(1 << 40))
    try:
        assert K.MONTH not in purchases_table(spark, SF_SMALL, months=True).columns
        assert len(purchases_table(spark, SF_SMALL).inputFiles()) <= 16
    finally:
        spark.conf.unset(MONTH_BYTES_CONF)


def test_shared_folder_without_any_setting(scratch):
    """A plain installation: no configuration folder, no checkpoint directory."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from storelens.session import build_session, scratch, shared_dir\n"
        "spark = build_session('local[1]', 1)\n"
        "path = scratch(spark, 'x')\n"
        "spark.range(3).write.parquet(path)\n"
        "assert spark.read.parquet(path).count() == 3\n"
        "assert path.startswith(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark, '/tmp/other')\n"
        "print('fine')\n"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": scratch, "TMPDIR": scratch}
    done = subprocess.run([sys.executable, "-c", code, ROOT], env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_catalog_database_is_a_source(spark, scratch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept_tables LOCATION '{scratch}/db'")
    try:
        for name, rows in (("a_list", 1), ("purchases_2024", 4), ("checkins_x", 2)):
            spark.range(rows).write.parquet(f"{scratch}/{name}")
            spark.catalog.createTable(f"kept_tables.{name}", path=f"{scratch}/{name}", source="parquet")
        got = readers.read_source(spark, ["catalog:absent", "catalog:kept_tables"])
        assert (got.purchases_table, got.checkins_table, got.fallback_reason) == ("purchases_2024", "checkins_x", None)
        assert (got.purchases.count(), got.checkins.count()) == (4, 2)
        with pytest.raises(FileNotFoundError):
            readers.read_source(spark, "catalog:absent")
        with pytest.raises(FileNotFoundError):
            readers.list_tables(spark, "catalog:absent")
    finally:
        spark.sql("DROP DATABASE kept_tables CASCADE")


def test_unreadable_catalog_table_falls_back(spark, scratch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept_broken LOCATION '{scratch}/db'")
    try:
        spark.range(3).write.parquet(f"{scratch}/all_lines")
        spark.catalog.createTable("kept_broken.all_lines", path=f"{scratch}/all_lines", source="parquet")
        spark.range(3).selectExpr("cast(id as string)").write.text(f"{scratch}/text")
        spark.sql(f"CREATE TABLE kept_broken.purchases (id BIGINT) USING parquet LOCATION '{scratch}/text'")
        got = readers.read_source(spark, "catalog:kept_broken")
        assert got.purchases_table == "all_lines" and got.purchases.count() == 3 and got.fallback_reason
    finally:
        spark.sql("DROP DATABASE kept_broken CASCADE")


def test_fresh_paths_differ(spark):
    assert fresh(spark, "a") != fresh(spark, "a")


def test_long_selection_is_a_join_with_the_same_rows(p):
    names = [r[0] for r in p.select("store_location").distinct().collect()][:4]
    long = names + [f"no store {i}" for i in range(100_000)] + names
    joined = flt.in_locations(p, long)
    assert joined.count() == flt.in_locations(p, names).count() > 0
    text = inspect.plan_text(joined)
    assert "no store 777" not in text and "BroadcastHashJoin" in text and len(text) < 50_000


def test_too_long_selections_are_not_broadcast(p, monkeypatch):
    monkeypatch.setattr(flt, "LITERAL_VALUES", 1)
    monkeypatch.setattr(flt, "BROADCAST_VALUES", 1)
    names = [r[0] for r in p.select("store_location").distinct().collect()][:4]
    joined = flt.in_locations(p, names)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()
    assert joined.count() == p.where(F.col("store_location").isin(names)).count()


def test_numeric_columns_are_compared_as_text_in_long_selections(spark):
    d = spark.range(20).withColumnRenamed("id", "location")
    assert flt.in_values(d, "location", [*range(5), *(f"x{i}" for i in range(20_000))]).count() == 5


# ---- sketches ----


def test_sketch_counts_of_few_invoices_are_exact(spark, p):
    few = p.where(F.col(K.INVOICE) <= 40)
    est = {r.year: (r.total_invoices, r.benefit_invoices) for r in sk.penetration_from_sketches(sk.day_sketches(few, PATTERN)).collect()}
    exact = {r.year: (r.total_invoices, r.benefit_invoices) for r in ben.benefit_penetration(few, PATTERN).collect()}
    assert est == exact and exact


def test_sketches_merge_over_written_days(spark, p, scratch):
    """Days kept in two tables give what one pass over all rows gives."""
    early = F.col("purchase_date") < F.lit("1998-01-01").cast("timestamp_ntz")
    for name, part in (("a", p.where(early)), ("b", p.where(~early))):
        sk.day_sketches(part, PATTERN).write.parquet(f"{scratch}/{name}")
    kept = spark.read.parquet(f"{scratch}/a", f"{scratch}/b")
    whole = sk.day_sketches(p, PATTERN)
    rows = lambda d: sorted(map(tuple, sk.penetration_from_sketches(d).collect()))
    assert rows(kept) == rows(whole) and len(rows(whole)) > 3
    assert sk.penetration_changes_from_sketches(kept).collect() == sk.penetration_changes_from_sketches(whole).collect()


def test_sketch_error_is_within_its_bound(spark):
    d = spark.range(200_000).selectExpr("timestamp_ntz'1999-03-01 10:00:00' AS purchase_date", "'x' AS revenue_subcategory", "id AS invoice_id")
    for lg_k in (8, 12, 14):
        r = sk.penetration_from_sketches(sk.day_sketches(d, "y", lg_k)).first()
        assert abs(r.total_invoices - 200_000) <= 4 * sk.standard_error(lg_k) * 200_000
        assert r.benefit_invoices == 0 and r.penetration_rate == 0


def test_sketches_of_null_text_and_decimal_invoices(spark):
    d = spark.sql(
        "SELECT timestamp_ntz'1999-01-01 00:00:00' AS purchase_date, 'x' AS revenue_subcategory, i AS invoice_id FROM VALUES ('1'), ('2'), ('2'), (NULL) t(i)"
    )
    for kind in ("string", "decimal(20,0)", "int"):
        r = sk.penetration_from_sketches(sk.day_sketches(d.withColumn("invoice_id", F.col("invoice_id").cast(kind)), "x")).first()
        assert (r.total_invoices, r.benefit_invoices, r.penetration_rate) == (2, 2, 100.0)
    assert sk.penetration_from_sketches(sk.day_sketches(d.limit(0), "x")).collect() == []


def test_penetration_from_sketches_shuffles_no_invoices(p):
    text = inspect.plan_text(sk.day_sketches(p, PATTERN))
    assert not [line for line in text.splitlines() if "hashpartitioning" in line and "invoice_id" in line]


def test_product_sketches_keep_exact_sums(p):
    keys = [K.SUBCATEGORY, K.PRODUCT]
    est = {tuple(r[:2]): tuple(r[2:]) for r in sk.product_stats_from_sketches(sk.product_sketches(p)).collect()}
    exact = {tuple(r[:2]): tuple(r[2:]) for r in prd.product_stats(p).select(*keys, "total_quantity", "total_sales", "avg_price", "unique_transactions").collect()}
    assert est == exact  # a product here has few invoices: counts are exact as well


# ---- pivot, periods ----


def test_pivot_forms_agree(p):
    quarters = ru.quarterly_profit(p).cache()
    years = sorted(r[0] for r in quarters.select("year").distinct().collect())
    wide = {r["quarter"]: [r[str(y)] for y in years] for r in yoy.pivot_quarters(quarters, "profit", years).collect()}
    cells = {(r.quarter, r.year): r.value for r in yoy.pivot_cells(quarters).collect()}
    maps = {r["quarter"]: r["by_year"] for r in yoy.quarter_year_pivot(p).collect()}
    assert wide == {q: [cells[q, y] for y in years] for q in wide}
    assert maps == {q: dict(zip(years, v, strict=True)) for q, v in wide.items()}


def test_pivot_cells_fill_missing_quarters(spark):
    q = spark.createDataFrame([(1, 1999, 5.0), (2, 2001, 7.0)], "quarter int, year int, profit double")
    got = sorted(map(tuple, yoy.pivot_cells(q).collect()))
    assert got == [(1, 1999, 5.0), (1, 2001, 0.0), (2, 1999, 0.0), (2, 2001, 7.0)]
    assert yoy.pivot_cells(q.limit(0)).collect() == [] and yoy.pivot_quarters(q.limit(0)).collect() == []


def test_pivot_without_years_reads_nothing_on_the_driver(spark, p, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    quarters = ru.quarterly_profit(p)
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    yoy.pivot_quarters(quarters)


def test_period_profit_is_months_and_quarters(p):
    got = ru.period_profit(p).collect()
    months = {tuple(r) for r in ru.monthly_profit(p).collect()}
    quarters = {tuple(r) for r in ru.quarterly_profit(p).collect()}
    assert {tuple(r)[1:] for r in got if r.grain == "month"} == months
    assert {tuple(r)[1:] for r in got if r.grain == "quarter"} == quarters
    assert len(got) == len(months) + len(quarters)
