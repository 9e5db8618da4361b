"""Source layouts and publication (FIXTURES.md §D)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from storelens.plans.catalog import QUERIES
from storelens.sources import publish, readers
from storelens.sources.star import purchases


def _write(df, path, fmt="parquet"):
    df.write.format(fmt).mode("errorifexists").option("header", "true").save(path)


def test_sheet_selection_by_name(spark, scratch):
    p = purchases(spark, SF_SMALL)
    _write(p.limit(3).select("invoice_id"), f"{scratch}/Notes")
    _write(p.limit(5), f"{scratch}/Purchases 2024")
    _write(spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(4), f"{scratch}/Checkins")
    pur, chk = readers.read_sales(spark, scratch)
    assert pur.count() == 5 and "purchase_price_w_discount" in pur.columns
    assert chk.count() == 4


def test_single_sheet_layout(spark, scratch):
    _write(purchases(spark, SF_SMALL).limit(7), f"{scratch}/Sheet1")
    pur, chk = readers.read_sales(spark, scratch)
    assert pur.count() == 7
    assert chk.columns == [] and chk.count() == 0


def test_priority_and_missing(spark, scratch):
    _write(purchases(spark, SF_SMALL).limit(2), f"{scratch}/synced/Purchases")
    pur, _ = readers.read_sales(spark, [f"{scratch}/nope", f"{scratch}/master", f"{scratch}/synced"])
    assert pur.count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_sales(spark, [f"{scratch}/nope", f"{scratch}/also-nope"])


def test_csv_export_is_cleaned(spark, scratch):
    from storelens.sources.clean import preprocess

    p = purchases(spark, SF_SMALL).limit(20)
    _write(p.select([F.col(c).cast("string") for c in p.columns]), f"{scratch}/purchases", fmt="csv")
    pur, _ = readers.read_sales(spark, scratch, fmt="csv")
    clean = preprocess(pur)
    assert dict(clean.dtypes)["purchase_date"] == "timestamp_ntz"
    assert dict(clean.dtypes)["purchase_price_w_discount"] == "double"
    assert clean.where(F.col("purchase_date").isNull()).count() == 0


def test_select_table():
    assert readers.select_table(["Notes", "Purchases 2024", "Checkins"], "purchase") == "Purchases 2024"
    assert readers.select_table(["Sheet1"], "checkin") is None


def test_publish_only_when_changed(spark, scratch):
    target = f"{scratch}/published"
    p = purchases(spark, SF_SMALL)
    assert publish.publish_if_changed(p, target) is True
    assert publish.publish_if_changed(p, target) is False
    # same rows in another order: still unchanged
    assert publish.publish_if_changed(p.orderBy(F.desc("invoice_id")), target) is False
    changed = p.withColumn("quantity", F.when(F.col("invoice_id") == 1, F.col("quantity") + 1).otherwise(F.col("quantity")))
    assert publish.publish_if_changed(changed, target) is True
    assert [v for v, _ in publish.versions(spark, target)] == [1, 2]
    assert os.path.basename(publish.latest_version(spark, target)) == "version=000002"


def test_multiset_equal_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert not publish.multiset_equal(a, b)
    assert publish.multiset_equal(a, a.orderBy("x"))


def test_unreadable_purchases_falls_back_to_first_table(spark, scratch):
    _write(purchases(spark, SF_SMALL).limit(3), f"{scratch}/A_first")
    os.makedirs(f"{scratch}/Purchases", exist_ok=True)
    with open(f"{scratch}/Purchases/part-00000.parquet", "w") as fh:
        fh.write("not a parquet file")
    pur, chk = readers.read_sales(spark, scratch)
    assert pur.count() == 3
    assert chk.columns == []


def test_publish_partitioned(spark, scratch):
    target = f"{scratch}/by_year"
    p = purchases(spark, SF_SMALL).withColumn("year", F.year("purchase_date"))
    assert publish.publish_if_changed(p, target, partition_by=["year"]) is True
    back = spark.read.parquet(publish.latest_version(spark, target))
    assert back.count() == p.count()
    assert publish.publish_if_changed(back.select(*p.columns), target, partition_by=["year"]) is False


def test_csv_export_roundtrip_to_canonical_fact(spark, scratch):
    from storelens.sources.clean import canonical, preprocess

    p = purchases(spark, SF_SMALL)
    _write(p.select([F.col(c).cast("string") for c in p.columns]), f"{scratch}/purchases", fmt="csv")
    pur, _ = readers.read_sales(spark, scratch, fmt="csv")
    fact = canonical(preprocess(pur))
    assert fact.schema == p.schema
    assert publish.multiset_equal(fact, p)


@pytest.mark.parametrize("other", ["metadata_notes", "part-numbers", "year=notes"])
def test_sheets_named_like_data(spark, scratch, other):
    p = purchases(spark, SF_SMALL)
    _write(p.limit(3).select("invoice_id"), f"{scratch}/{other}.parquet")
    _write(p.limit(5), f"{scratch}/purchases.parquet")
    src = readers.read_source(spark, scratch)
    assert src.purchases.count() == 5 and src.purchases_table == "purchases" and src.fallback_reason is None


def test_one_table_folder(spark, scratch):
    _write(purchases(spark, SF_SMALL).limit(50).repartition(3), f"{scratch}/flat")
    purchases(spark, SF_SMALL).limit(50).write.partitionBy("store_location").parquet(f"{scratch}/parted")
    for name in ("flat", "parted"):
        assert [t.name for t in readers.list_tables(spark, f"{scratch}/{name}")] == [name]
        assert readers.read_sales(spark, f"{scratch}/{name}")[0].count() == 50


def test_fallback_is_reported(spark, scratch):
    _write(purchases(spark, SF_SMALL).limit(3), f"{scratch}/A_first")
    os.makedirs(f"{scratch}/Purchases")
    with open(f"{scratch}/Purchases/part-00000.parquet", "w") as fh:
        fh.write("not a parquet file")
    src = readers.read_source(spark, scratch)
    assert src.purchases_table == "A_first" and src.fallback_reason


def test_publish_after_a_lost_job(spark, scratch):
    target, p = f"{scratch}/published", purchases(spark, SF_SMALL).limit(40)
    assert publish.publish_if_changed(p, target)
    os.makedirs(f"{target}/version=000002/_temporary")
    more = p.unionByName(p.limit(1))
    assert publish.publish_if_changed(more, target) and not publish.publish_if_changed(more, target)
    assert [v for v, _ in publish.versions(spark, target)] == [1, 3]


def test_publish_csv_only_when_changed(spark, scratch):
    target, p = f"{scratch}/csv", purchases(spark, SF_SMALL).limit(40)
    assert publish.publish_if_changed(p, target, fmt="csv")
    assert not publish.publish_if_changed(p, target, fmt="csv")
    assert publish.publish_if_changed(p.limit(39), target, fmt="csv")


def test_publish_with_a_partition_column_in_front(spark, scratch):
    target = f"{scratch}/by_year"
    p = purchases(spark, SF_SMALL).select(F.year("purchase_date").alias("year"), "*")
    assert publish.publish_if_changed(p, target, partition_by=["year"])
    assert not publish.publish_if_changed(p, target, partition_by=["year"])


def test_diff(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "v string, k int")
    assert {tuple(r) for r in publish.diff(a, b).collect()} == {("x", 1, -1), ("y", 2, -1), ("z", 3, 1)}


def test_registered_pivots_keep_every_year_of_the_fact(spark, scratch):
    for t in ("lineitem", "customer", "nation", "part", "supplier"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", f"{scratch}/{t}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    later = F.when(F.year("o_orderdate") == 1996, F.add_months("o_orderdate", 120)).otherwise(F.col("o_orderdate"))
    _write(orders.withColumn("o_orderdate", later.cast(orders.schema["o_orderdate"].dataType)), f"{scratch}/orders.parquet")
    for value in ("profit", "margin"):
        got = QUERIES[f"quarter_year_pivot_{value}"](spark, scratch)
        assert sorted(got.columns) == sorted(["quarter", "1995", *map(str, range(1997, 2002)), "2006"])
