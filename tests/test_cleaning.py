"""Dirty source rows (FIXTURES.md §C)."""

import datetime as dt

import pytest

from storelens.sources import clean


def test_preprocess_dirty_columns(spark):
    df = spark.createDataFrame(
        [
            ("2024-01-02", "1.5", "10", "4.20"),
            ("03/04/2024", " 2 ", "abc", "4.20"),
            ("x", "$3", None, None),
            (None, "1,000", None, None),
            (None, "1e3", None, None),
            (None, None, None, None),
        ],
        "` purchase_date ` string, unit_price string, `Amount ` string, unit_cost string",
    )
    out = clean.preprocess(df)
    assert out.columns == ["purchase_date", "unit_price", "Amount", "unit_cost"]
    assert dict(out.dtypes) == {"purchase_date": "timestamp_ntz", "unit_price": "double", "Amount": "double",
                                "unit_cost": "string"}
    rows = out.collect()
    assert [r["purchase_date"] for r in rows] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 3, 4), None, None,
                                                  None, None]
    assert [r["unit_price"] for r in rows] == [1.5, 2.0, None, None, 1000.0, None]
    assert [r["Amount"] for r in rows[:2]] == [10.0, None]
    assert rows[0]["unit_cost"] == "4.20"


def test_numeric_and_timestamp_columns_untouched(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 2.5)], "order_date timestamp_ntz, price double")
    out = clean.preprocess(df)
    assert out.dtypes == [("order_date", "timestamp_ntz"), ("price", "double")]
    assert out.first() == (dt.datetime(2024, 1, 1, 5), 2.5)


def test_trim_collision_rejected(spark):
    df = spark.createDataFrame([(1, 2)], "`a ` int, ` a` int")
    with pytest.raises(ValueError):
        clean.clean_columns(df)


def test_parse_money_inverse(spark):
    from pyspark.sql import functions as F

    from storelens.functions import money_text, parse_money

    df = spark.createDataFrame([(1234.5,), (-20.0,), (0.4,)], "x double")
    got = df.select(money_text("x", 0).alias("t")).select("t", parse_money("t").alias("v")).collect()
    assert [(r["t"], r["v"]) for r in got] == [("$1,234", 1234.0), ("$-20", -20.0), ("$0", 0.0)]
    assert df.select(F.lit(1)).count() == 3


def test_text_dates_ignore_session_zone(spark):
    """A wall-clock time inside a DST gap keeps its value (no zone involved)."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-10 02:30:00",)], "order_date string")
        assert clean.preprocess(df).first()[0] == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_nan_becomes_null(spark):
    from storelens.operators import rollups as ru

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "purchase_price_w_discount double")
    out = clean.preprocess(df)
    assert [r[0] for r in out.collect()] == [1.0, None, None]
    assert ru.sales_kpis(out).first()["total_sales"] == 1.0


@pytest.mark.parametrize(("text", "want"), [
    ("3/4/2024", dt.datetime(2024, 3, 4)), ("3/4/2024 9:05", dt.datetime(2024, 3, 4, 9, 5)),
    ("2024-01-02 03:04:05.123", dt.datetime(2024, 1, 2, 3, 4, 5, 123000)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("2024/01/02", dt.datetime(2024, 1, 2)), ("2024-01-02 03:04", dt.datetime(2024, 1, 2, 3, 4)),
    ("2024-01-02T03:04:05.5+02:00", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)), ("3/4/2024 9:05 PM", dt.datetime(2024, 3, 4, 21, 5)),
    ("2024-13-01", None), ("2024-02-30", None), ("T", None), ("", None), ("12", None),
])
def test_date_forms(spark, text, want):
    assert clean.preprocess(spark.createDataFrame([(text,)], "order_date string")).first()[0] == want


def test_texts_that_are_no_plain_numbers(spark):
    texts = ["nan", "NaN", "Infinity", "-inf", "2d", "1f", "0x1", "1e", ".", "-.5", "+3", "7.", "1e-2"]
    out = clean.preprocess(spark.createDataFrame([(t,) for t in texts], "price string")).collect()
    assert [r[0] for r in out] == [None] * 9 + [-0.5, 3.0, 7.0, 0.01]


def test_losses_are_counted(spark):
    df = spark.createDataFrame([("2024-01-02", "1"), ("x", "nan"), (None, " ")], "d_date string, price string")
    assert {tuple(r) for r in clean.parse_losses(df).collect()} == {("d_date", 2, 1, 1), ("price", 2, 1, 1)}
    assert clean.parse_losses(df.select(df.d_date.alias("note"))).count() == 0
