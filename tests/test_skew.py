"""Hot keys: a third of all lines on one invoice, one vendor and one
subcategory.  Every registered query must still equal its oracle, with AQE's
skew-join splitting forced on by tiny thresholds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from oracle_check import compare
from storelens.plans import catalog
from storelens.plans.oracles import ORACLES
from storelens.sources.star import PURCHASES_SQL, purchases, with_null_keys

SKIP = {"checkins_clean", "fingerprint", "source_first_table"}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew") / "purchases")
    hot = (F.col("invoice_id") % 3) == 0
    p = purchases(spark, SF_SMALL).select(
        "purchase_date",
        F.when(hot, F.lit(0)).otherwise(F.col("invoice_id")).cast("bigint").alias("invoice_id"),
        "store_location",
        "disp_category",
        F.when(hot, F.lit("Brand#7")).otherwise(F.col("revenue_subcategory")).alias("revenue_subcategory"),
        "product_name",
        F.when(hot, F.lit("Supplier#hot")).otherwise(F.col("vendor_name")).alias("vendor_name"),
        "quantity",
        "purchase_price_w_discount",
        "unit_cost",
    )
    p.write.parquet(path)
    return path


@pytest.fixture(scope="module")
def forced_skew(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SKIP))
def test_hot_keys_match_oracle(spark, skewed, forced_skew, monkeypatch, name):
    table = spark.read.parquet(skewed)
    monkeypatch.setattr(catalog, "fact", lambda s, d, nulls=False, months=True: with_null_keys(table) if nulls else table)
    df = catalog.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = ORACLES[name].replace(PURCHASES_SQL, f"SELECT * FROM read_parquet('{skewed}/*.parquet')")
    con = duckdb.connect()
    cur = con.execute(sql)
    status, detail = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert status in ("exact", "close"), f"{name}: {status} {detail}"
