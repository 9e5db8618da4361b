"""Role resolution, expression helpers and filter paths not covered elsewhere."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rows import make
from storelens.functions import MissingRole, first_word, resolve_roles, truncate_label
from storelens.functions import constants as K
from storelens.operators import filters as flt
from storelens.operators import rollups as ru
from storelens.sources import clean
from storelens.sources.star import purchases


def test_roles_follow_the_name_rules(spark):
    df = spark.createDataFrame(
        [("x", "y", dt.datetime(2024, 1, 1), "2024-01-01", 1.0)],
        "site_code string, shop_name string, order_date timestamp_ntz, ship_date string, purchase_price_w_discount double",
    )
    r = resolve_roles(df.schema)
    assert r.location == "site_code"  # first of location/store/shop/site
    assert r.date == "order_date"  # first datetime-typed 'date' column
    assert resolve_roles(df.schema, K.RANKING_LOCATION_WORDS).location == "shop_name"  # no 'site'
    assert r.price == "purchase_price_w_discount" and r.cost is None
    with pytest.raises(MissingRole):
        ru.profit_kpis(df)


def test_long_membership_list_uses_a_join(spark):
    p = purchases(spark, SF_SMALL)
    many = [f"NATION_{i}" for i in range(25)] + [f"nowhere-{i}" for i in range(2000)]
    assert flt.in_locations(p, many).count() == p.count()
    few = flt.in_locations(p, ["NATION_3"]).count()
    assert flt.in_locations(p, ["NATION_3"] + [f"nowhere-{i}" for i in range(2000)]).count() == few
    assert flt.in_locations(p, []).count() == p.count()  # empty selection: no filter


def test_numeric_location_matches_as_text(spark):
    df = make(spark, {}, {}).withColumn("store_location", F.lit(7))
    assert flt.in_locations(df, ["7"]).count() == 2


def test_subcategory_filter_only_inside_categories(spark):
    p = purchases(spark, SF_SMALL)
    assert flt.in_subcategories(p, ["Brand#1"], categories=[]).count() == p.count()
    inside = flt.in_subcategories(flt.in_categories(p, ["SMALL"]), ["Brand#1"], categories=["SMALL"])
    assert inside.where(F.col("revenue_subcategory") != "Brand#1").count() == 0


def test_label_helpers(spark):
    df = spark.createDataFrame([("Supplier#000000001",), ("short",), ("Morning (5AM-12PM)",)], "s string")
    got = df.select(truncate_label("s").alias("t"), first_word("s").alias("w")).collect()
    assert [r["t"] for r in got] == ["Supplier#000000...", "short", "Morning (5AM-12..."]
    assert [r["w"] for r in got] == ["Supplier#000000001", "short", "Morning"]


def test_standalone_coercions(spark):
    df = spark.createDataFrame([("2024-05-06 07:08:09", " 3.5 ")], "purchase_date string, amount string")
    assert clean.coerce_dates(df).first()[0] == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert clean.coerce_numbers(df).first()[1] == 3.5
    assert clean.coerce_dates(df).dtypes[1] == ("amount", "string")


def test_default_selection_is_first_five(spark):
    p = purchases(spark, SF_SMALL)
    opts = [r[0] for r in flt.filter_options(p, "location").collect()]
    assert [r[0] for r in flt.default_selection(p, "location").collect()] == opts[:5]
    assert opts == sorted(opts)
