"""Edge rows of FIXTURES.md §B: boundaries, ties, nulls, gaps, thresholds."""

import datetime as dt

import pytest

from rows import make, ts
from storelens.functions import half_even
from storelens.operators import benefits as ben
from storelens.operators import filters as flt
from storelens.operators import insights as ins
from storelens.operators import products as prd
from storelens.operators import rollups as ru
from storelens.operators import vendors as ven
from storelens.operators import yoy


def test_midnight_end_bound(spark):
    df = make(spark, {"purchase_date": "2024-01-31 00:00:00"}, {"purchase_date": "2024-01-31 09:00:00"},
              {"purchase_date": "2024-01-01 00:00:00"})
    assert flt.date_range(df, "2024-01-01", "2024-01-31").count() == 2
    assert flt.date_range(df, "2024-01-01", "2024-01-31", end_inclusive="day").count() == 3
    # default bounds: first day to last day, midnight
    assert flt.all_time(df).count() == 2


def test_null_dates_never_pass(spark):
    df = make(spark, {"purchase_date": None}, {"purchase_date": "2024-01-10 00:00:00"})
    assert flt.all_time(df).count() == 1
    assert flt.year_to_date(df).count() == 1


def test_last_n_days(spark):
    df = make(spark, {"purchase_date": "2024-03-31 10:00:00"}, {"purchase_date": "2024-03-01 00:00:00"},
              {"purchase_date": "2024-02-29 23:00:00"}, {"purchase_date": "2024-03-31 00:00:00"})
    # 30 days before 2024-03-31 = 2024-03-01 00:00 .. 2024-03-31 00:00
    assert flt.last_n_days(df, 30).count() == 2


def test_week_label(spark):
    df = make(spark, {"purchase_date": "2024-01-07 00:00:00", "purchase_price_w_discount": 1},
              {"purchase_date": "2024-01-07 15:00:00", "purchase_price_w_discount": 2},
              {"purchase_date": "2024-01-08 00:00:00", "purchase_price_w_discount": 4})
    got = {r["week_ending"]: r["sales"] for r in ru.weekly_sales(df).collect()}
    assert got == {dt.datetime(2024, 1, 7): 3.0, dt.datetime(2024, 1, 14): 4.0}


def test_gap_weeks(spark):
    df = make(spark, {"purchase_date": "2024-01-05 10:00:00", "purchase_price_w_discount": 6},
              {"purchase_date": "2024-01-10 10:00:00", "purchase_price_w_discount": 4},
              {"purchase_date": "2024-01-25 10:00:00", "purchase_price_w_discount": 5})
    combined = {r["week_ending"]: r["sales"] for r in ru.weekly_sales(df).collect()}
    assert combined == {dt.datetime(2024, 1, 7): 6.0, dt.datetime(2024, 1, 14): 4.0, dt.datetime(2024, 1, 21): 0.0,
                        dt.datetime(2024, 1, 28): 5.0}
    by_loc = ru.weekly_sales(df, by_location=True).collect()
    assert len(by_loc) == 3


def test_all_null_measure(spark):
    df = make(spark, {"vendor_name": "a", "purchase_price_w_discount": None},
              {"vendor_name": "a", "purchase_price_w_discount": None})
    r = ven.vendor_performance(df).first()
    assert (r["total_sales"], r["transaction_count"], r["avg_transaction"]) == (0.0, 0, None)


def test_null_key_out_of_rollup_in_denominator(spark):
    df = make(spark, {"vendor_name": None, "purchase_price_w_discount": 3},
              {"vendor_name": "a", "purchase_price_w_discount": 6})
    assert [r["vendor_name"] for r in ven.vendor_performance(df).collect()] == ["a"]
    c = ven.vendor_concentration(df).first()
    assert c["total_vendors"] == 1
    assert c["top5_share"] == pytest.approx(6 / 9 * 100)


def test_half_even(spark):
    df = spark.createDataFrame([(0.125,), (1.015,), (2.675,), (0.25,), (0.35,)], "x double")
    got = [(r[0], r[1]) for r in df.select(half_even("x", 2), half_even("x", 1)).collect()]
    assert [g[0] for g in got[:3]] == [0.12, 1.01, 2.68]
    assert [g[1] for g in got[3:]] == [0.2, 0.4]


def _two_year_quarters(spark, cur_price, cur_cost, prev_price=100, prev_cost=90):
    return make(
        spark,
        {"purchase_date": "2023-02-01 10:00:00", "purchase_price_w_discount": prev_price, "unit_cost": prev_cost},
        {"purchase_date": "2024-02-01 10:00:00", "purchase_price_w_discount": cur_price, "unit_cost": cur_cost},
    )


def test_zero_revenue_quarter_margin_change_is_zero(spark):
    # previous margin 10; current quarter revenue 0, cost 5 -> margin inf -> cell 0, change 0
    q1 = [r for r in yoy.yoy_quarterly(_two_year_quarters(spark, 0, 5)).collect() if r["quarter"] == "Q1"][0]
    assert q1["prev_margin"] == 10.0 and q1["cur_margin"] == 0.0 and q1["margin_change"] == 0.0


def test_zero_profit_zero_revenue_margin_change(spark):
    q1 = [r for r in yoy.yoy_quarterly(_two_year_quarters(spark, 0, 0)).collect() if r["quarter"] == "Q1"][0]
    assert q1["cur_margin"] == 0.0 and q1["margin_change"] == -10.0


def test_previous_profit_zero_change_pct(spark):
    q1 = [r for r in yoy.yoy_quarterly(_two_year_quarters(spark, 150, 100, 90, 90)).collect()
          if r["quarter"] == "Q1"][0]
    assert q1["prev_profit"] == 0.0 and q1["cur_profit"] == 50.0 and q1["profit_change_pct"] == 0.0


def test_yoy_always_four_quarters(spark):
    t = yoy.yoy_quarterly(_two_year_quarters(spark, 100, 50)).collect()
    assert [r["quarter"] for r in sorted(t, key=lambda r: r["quarter"])] == ["Q1", "Q2", "Q3", "Q4"]
    assert all(r["prev_profit"] == 0.0 for r in t if r["quarter"] != "Q1")


def test_minimum_transaction_counts(spark):
    rows = []
    for vendor, n in (("v10", 10), ("v9", 9), ("v5", 5), ("v4", 4)):
        rows += [{"vendor_name": vendor, "invoice_id": i} for i in range(n)]
    df = make(spark, *rows)
    by_margin = {r["vendor_name"] for r in ven.top_vendors(df, "profit_margin", 15, min_txns=10).collect()}
    by_avg = {r["vendor_name"] for r in ven.top_vendors(df, "avg_transaction", 15, min_txns=5).collect()}
    assert by_margin == {"v10"}
    assert by_avg == {"v10", "v9", "v5"}


def test_non_adjacent_years(spark):
    df = make(spark, {"purchase_date": "2021-01-05 10:00:00"}, {"purchase_date": "2024-01-05 10:00:00"})
    r = yoy.ytd_changes(df).first()
    assert (r["prev_year"], r["cur_year"]) == (2021, 2024)


def test_single_year(spark):
    df = make(spark, {"purchase_date": "2024-01-05 10:00:00", "revenue_subcategory": "Member Bennies",
                      "purchase_price_w_discount": -5})
    assert yoy.ytd_changes(df).count() == 0
    assert yoy.yoy_quarterly(df).count() == 0
    assert ben.benefit_changes(df).count() == 0
    b = ben.benefit_ytd(df).collect()
    assert len(b) == 1 and b[0]["total_benefit_value"] == -5.0


def test_leap_day_as_of(spark):
    df = make(spark, {"purchase_date": "2024-02-29 10:00:00"}, {"purchase_date": "2023-02-28 10:00:00"},
              {"purchase_date": "2023-03-01 10:00:00"})
    got = sorted(r["purchase_date"] for r in flt.year_to_date(df).collect())
    assert got == [ts("2023-02-28 10:00:00"), ts("2024-02-29 10:00:00")]


def test_top_product_tie_lower_name_wins(spark):
    df = make(spark, {"product_name": "Zeta", "quantity": 3.0, "invoice_id": 1},
              {"product_name": "Alpha", "quantity": 3.0, "invoice_id": 2})
    r = prd.product_highlights(df).first()
    assert r["product"] == "Alpha" and r["qty_sold"] == 3


def test_redemption_direction(spark):
    def data(delta):
        return make(
            spark,
            {"purchase_date": "2023-01-05 10:00:00", "revenue_subcategory": "Member Bennies",
             "purchase_price_w_discount": -2000, "unit_cost": 0},
            {"purchase_date": "2024-01-05 10:00:00", "revenue_subcategory": "Member Bennies",
             "purchase_price_w_discount": -2000 + delta, "unit_cost": 0},
            {"purchase_date": "2023-01-05 11:00:00", "purchase_price_w_discount": 50000, "unit_cost": 0},
            {"purchase_date": "2024-01-05 11:00:00", "purchase_price_w_discount": 50000, "unit_cost": 0},
        )

    more = data(-1500)
    less = data(1500)
    assert ben.benefit_changes(more).first()["direction"] == "more"
    assert ben.benefit_changes(less).first()["direction"] == "less"
    assert {r["code"] for r in ins.benefit_insights(more).collect()} == {"increased_usage"}
    assert {r["code"] for r in ins.benefit_insights(less).collect()} == {"decreased_usage"}


def test_thresholds_exactly_at_limit_do_not_fire(spark):
    # value change exactly -1000, count change 0
    df = make(
        spark,
        {"purchase_date": "2023-01-05 10:00:00", "revenue_subcategory": "Member Bennies", "purchase_price_w_discount": -1000},
        {"purchase_date": "2024-01-05 10:00:00", "revenue_subcategory": "Member Bennies", "purchase_price_w_discount": -2000},
        {"purchase_date": "2023-01-05 11:00:00", "purchase_price_w_discount": 50000},
        {"purchase_date": "2024-01-05 11:00:00", "purchase_price_w_discount": 50000},
    )
    assert ins.benefit_insights(df).count() == 0


def test_daypart_borders(spark):
    hours = [4, 5, 11, 12, 16, 17, 20, 21]
    df = make(spark, *[{"purchase_date": f"2024-01-05 {h:02d}:00:00"} for h in hours])
    got = {r["hour"]: r["time_period"].split(" ")[0] for r in ru.hourly_sales(df).collect()}
    assert [got[h] for h in hours] == ["Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening",
                                       "Evening", "Night"]


def test_benefit_null_subcategory(spark):
    df = make(spark, {"revenue_subcategory": None, "purchase_price_w_discount": 7},
              {"revenue_subcategory": "Member Bennies", "purchase_price_w_discount": -1})
    assert ben.benefit_lines(df).count() == 1
    ex = ru.subcategory_sales(df, exclude_pattern="Member Bennies").collect()
    assert ex == []


def test_empty_input(spark):
    df = make(spark).limit(0) if False else spark.createDataFrame([], make(spark, {}).schema)
    k = ru.sales_kpis(df).first()
    assert (k["total_sales"], k["transactions"], k["avg_basket"]) == (0.0, 0, None)
    assert ru.profit_by_subcategory(df).count() == 0
    assert ru.peak_time(df).count() == 0
    assert ru.weekly_sales(df).count() == 0


def test_peak_time_first_hour_on_tie(spark):
    df = make(spark, {"purchase_date": "2024-01-05 14:00:00", "purchase_price_w_discount": 5},
              {"purchase_date": "2024-01-05 09:00:00", "purchase_price_w_discount": 5})
    r = ru.peak_time(df).first()
    assert r["best_hour"] == 9 and r["best_hour_label"] == "9:00" and r["best_period"] == "Afternoon"
