"""Every insight rule exactly at its limit does not fire; just past it, it does
(FIXTURES.md §B "thresholds")."""

from pyspark.sql import functions as F

from storelens.operators import insights as ins


def _row(spark, **vals):
    return spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} double" for k in vals))


def _codes(df):
    return sorted(r["code"] for r in df.collect())


def test_profitability_rules_at_limits(spark):
    at = _row(spark, revenue_change=0.0, cost_change=5.0, avg_price_change=-2.0, avg_cost_change=0.0,
              transaction_change=-5.0)
    assert _codes(ins.profitability_rules(at)) == ["no_red_flags"]
    past = _row(spark, revenue_change=0.0, cost_change=5.01, avg_price_change=-2.01, avg_cost_change=0.0,
                transaction_change=-5.01)
    assert _codes(ins.profitability_rules(past)) == ["cost_inflation", "cost_structure", "price_pressure",
                                                    "volume_decline"]


def test_benefit_rules_at_limits(spark):
    at = _row(spark, value_change=-1000.0, count_change=100.0, cur_total_revenue=1.0)
    assert _codes(ins.benefit_rules(at)) == []
    assert _codes(ins.benefit_rules(_row(spark, value_change=1000.0, count_change=-100.0, cur_total_revenue=1.0))) == []
    past = _row(spark, value_change=-1000.01, count_change=101.0, cur_total_revenue=1.0)
    assert _codes(ins.benefit_rules(past)) == ["increased_usage", "more_members"]
    no_revenue = _row(spark, value_change=-5000.0, count_change=500.0, cur_total_revenue=0.0)
    assert _codes(ins.benefit_rules(no_revenue)) == []


def test_penetration_rules_at_limits(spark):
    at = _row(spark, rate_change=2.0, current_rate=15.0)
    assert _codes(ins.penetration_rules(at, F.lit(-1000.0))) == []
    low = _row(spark, rate_change=-2.0, current_rate=5.0)
    assert _codes(ins.penetration_rules(low, F.lit(None).cast("double"))) == []
    past = _row(spark, rate_change=2.01, current_rate=15.01)
    assert _codes(ins.penetration_rules(past, F.lit(-1000.01))) == ["double_impact", "high_penetration",
                                                                    "higher_engagement"]
    # a missing value change makes the double-impact rule false
    assert "double_impact" not in _codes(ins.penetration_rules(past, F.lit(None).cast("double")))
    falling = _row(spark, rate_change=-2.01, current_rate=4.99)
    assert _codes(ins.penetration_rules(falling, F.lit(0.0))) == ["low_penetration", "lower_engagement"]


def test_category_rules_at_limits(spark):
    assert _codes(ins.category_rules(_row(spark, penetration_change=1.0, current_rate=10.0))) == []
    assert _codes(ins.category_rules(_row(spark, penetration_change=-1.0, current_rate=5.0))) == []
    assert _codes(ins.category_rules(_row(spark, penetration_change=1.01, current_rate=10.01))) == [
        "good_category_adoption", "more_category_customers"]
    assert _codes(ins.category_rules(_row(spark, penetration_change=-1.01, current_rate=4.99))) == [
        "fewer_category_customers", "low_category_adoption"]
