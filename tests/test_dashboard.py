"""The filter-state composition end to end."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from storelens.functions import resolve_roles
from storelens.plans import dashboard
from storelens.sources.cache import cached, release
from storelens.sources.star import purchases


def test_every_section_runs_lazily_then_collects(spark):
    p = purchases(spark, SF_SMALL)
    state = dashboard.FilterState(preset="last_90", locations=(), categories=("STANDARD", "SMALL"),
                                  subcategories=("Brand#25", "Brand#3"))
    board = dashboard.Dashboard(p, state, pattern="brand#25", category="STANDARD")
    sections = board.sections()
    assert len(sections) >= 30
    for name, df in sections.items():
        df.collect()  # every section is a valid plan
    kpi = sections["kpis"].first()
    manual = p.where(F.col("disp_category").isin("STANDARD", "SMALL")).where(
        F.col("revenue_subcategory").isin("Brand#25", "Brand#3"))
    assert kpi["transactions"] <= manual.count()


def test_default_state_matches_manual_filters(spark):
    p = purchases(spark, SF_SMALL)
    v = dashboard.apply(p)
    locs = sorted(r[0] for r in p.select("store_location").distinct().collect())[:5]
    cats = sorted(r[0] for r in p.select("disp_category").distinct().collect())[:5]
    last_day = p.agg(F.to_date(F.max("purchase_date"))).first()[0]
    manual = p.where(F.col("store_location").isin(locs) & F.col("disp_category").isin(cats)
                     & (F.col("purchase_date") <= F.lit(str(last_day)).cast("timestamp_ntz")))
    assert v.count() == manual.count() > 0


def test_cached_roundtrip(spark):
    p = cached(purchases(spark, SF_SMALL))
    assert p.count() == p.count()
    release(p)


def test_resolved_state_equals_lazy_state(spark):
    from storelens.sources import publish

    p = purchases(spark, SF_SMALL)
    for state in (dashboard.FilterState(), dashboard.FilterState(preset="last_90", categories=("SMALL",))):
        eager = dashboard.Dashboard(p, state, pattern="brand#25", category="STANDARD", resolve=True, gate_yoy=False).sections()
        lazy = dashboard.Dashboard(p, state, pattern="brand#25", category="STANDARD", resolve=False).sections()
        for name in ("kpis", "ytd_metrics", "benefit_penetration", "category_with_benefit", "yoy_quarterly",
                     "vendor_concentration", "weekly_sales"):
            assert publish.multiset_equal(eager[name], lazy[name]), (state, name)


def test_cube_sections_equal_operator_sections(spark):
    from storelens.sources import publish

    p = purchases(spark, SF_SMALL)
    state = dashboard.FilterState(categories=("STANDARD", "SMALL", "MEDIUM"))
    cube_board = dashboard.Dashboard(p, state, pattern="brand#25", category="STANDARD", resolve=True)
    eager = cube_board.sections()
    plain = dashboard.Dashboard(p, cube_board.state, pattern="brand#25", category="STANDARD", resolve=False)
    plain.as_of = cube_board.as_of
    lazy = plain.sections()
    for name in ("kpis", "profit_kpis", "weekly_sales", "monthly_profit", "quarterly_profit", "ytd_metrics",
                 "ytd_changes", "profitability_insights", "benefit_ytd", "benefit_monthly", "benefit_changes",
                 "benefit_revenue_share",
                 "benefit_insights", "penetration_insights", "yoy_quarterly_long", "quarter_year_pivot", "hourly_sales", "daypart_sales", "peak_time",
                 "weekday_sales"):
        assert publish.multiset_equal(eager[name], lazy[name]), name


def test_yoy_block_hidden_with_one_month(spark):
    from rows import make

    one_month = make(spark, {"purchase_date": "2024-03-05 10:00:00"}, {"purchase_date": "2024-03-20 10:00:00"})
    board = dashboard.Dashboard(one_month, dashboard.FilterState(locations=(), categories=()))
    assert board.yoy_ready() is False
    sections = board.sections()
    for name in dashboard.YOY_BLOCK:
        assert sections[name].count() == 0, name
    # all-time bounds end at midnight of the last day, so its 10:00 line is out (D-2)
    assert sections["kpis"].first()["transactions"] == 1
    p = purchases(spark, SF_SMALL)
    assert dashboard.Dashboard(p, pattern="brand#25", category="STANDARD").yoy_ready() is True


@pytest.mark.parametrize("column", ["unit_cost", "vendor_name", "invoice_id", "store_location", "quantity", "disp_category",
                                    "purchase_date", "product_name", "revenue_subcategory", "purchase_price_w_discount"])
def test_sections_without_a_column(spark, column):
    """COL-5: the sections whose columns are there still show."""
    board = dashboard.Dashboard(purchases(spark, SF_SMALL).drop(column), pattern="brand#25", category="STANDARD")
    role = next(k for k, v in vars(resolve_roles(purchases(spark, SF_SMALL).schema)).items() if v == column)
    sections = board.sections()
    assert set(sections) == {n for n, needs in dashboard.NEEDS.items() if role not in needs}
    for name in list(sections)[::4]:
        sections[name].collect()


def test_all_sections_are_listed(spark):
    board = dashboard.Dashboard(purchases(spark, SF_SMALL), pattern="brand#25", category="STANDARD")
    assert set(board.sections()) == set(dashboard.NEEDS)
    rows = board.collect_all(names=["vendors_by_sales", "vendor_performance", "preview", "vendor_detail"])
    assert set(rows) == {"vendors_by_sales", "preview", "vendor_detail"} and len(rows["vendors_by_sales"]) <= 15


def test_one_year_hides_the_yoy_block(spark):
    p = purchases(spark, SF_SMALL).where(F.year("purchase_date") == 1998)
    board = dashboard.Dashboard(p, dashboard.FilterState(locations=(), categories=()), pattern="brand#25", category="STANDARD")
    assert board.yoy_ready() is False and board.sections()["ytd_metrics"].count() == 0


def test_no_penetration_insight_without_benefit_lines(spark):
    from storelens.operators import insights

    p = purchases(spark, SF_SMALL)
    assert insights.penetration_insights(p, "no such pattern").count() == 0
    assert [r["code"] for r in insights.benefit_insights(p, p, "no such pattern").collect()] == ["no_benefit_data"]
