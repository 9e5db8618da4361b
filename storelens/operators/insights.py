"""Threshold rules over the one-row change tables.

Every rule becomes a row ``(section, code, severity, message, value)``:
``inline(array_compact(array(when(cond, struct(...)), ...)))`` over the
single change row, so the rules stay one projection.  All comparisons are
strict; thresholds are keyword arguments with the reference's defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import is_benefit
from ..functions.roles import ColumnRoles, roles_of
from .benefits import (
    benefit_changes,
    benefit_changes_with_revenue,
    category_penetration_change,
    penetration_changes,
)
from .yoy import ytd_changes

INSIGHT_SCHEMA = "section string, code string, severity string, message string, value double"


@dataclass(frozen=True)
class Rule:
    when: Column
    code: str
    severity: str
    message: str
    value: Column


def _row(section: str, rule: Rule) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(rule.code).alias("code"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.message).alias("message"),
        rule.value.cast("double").alias("value"),
    )


def apply_rules(one_row: DataFrame, section: str, rules: list[Rule], fallback: Rule | None = None) -> DataFrame:
    """Evaluate ``rules`` on each (normally the only) row of ``one_row``."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(r.when, F.lit(False)), _row(section, r)) for r in rules]))
    if fallback is not None:
        fired = F.when(F.size(fired) == 0, F.array(_row(section, fallback))).otherwise(fired)
    return one_row.select(F.inline(fired))


def profitability_insights(
    df: DataFrame,
    as_of=None,
    cost_vs_price_pp: float = 2.0,
    volume_drop_pct: float = -5.0,
    price_drop_pct: float = -2.0,
    cost_vs_revenue_pp: float = 5.0,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """INS-1: causes of a profitability change (YTD, latest vs. previous year)."""
    return profitability_rules(
        ytd_changes(df, as_of, roles), cost_vs_price_pp, volume_drop_pct, price_drop_pct, cost_vs_revenue_pp
    )


def profitability_rules(
    ch: DataFrame,
    cost_vs_price_pp: float = 2.0,
    volume_drop_pct: float = -5.0,
    price_drop_pct: float = -2.0,
    cost_vs_revenue_pp: float = 5.0,
) -> DataFrame:
    """INS-1 over an already computed YOY-4 change row."""
    c = F.col
    rules = [
        Rule(c("avg_cost_change") > c("avg_price_change") + cost_vs_price_pp, "cost_inflation", "alert",
             "Unit costs rose faster than selling prices", c("avg_cost_change") - c("avg_price_change")),
        Rule(c("transaction_change") < volume_drop_pct, "volume_decline", "alert",
             "Transaction count dropped significantly", c("transaction_change")),
        Rule(c("avg_price_change") < price_drop_pct, "price_pressure", "alert",
             "Average selling prices declined", c("avg_price_change")),
        Rule(c("cost_change") > c("revenue_change") + cost_vs_revenue_pp, "cost_structure", "alert",
             "Total costs grew much faster than revenue", c("cost_change") - c("revenue_change")),
    ]
    ok = Rule(F.lit(True), "no_red_flags", "ok", "Changes appear proportional", F.lit(None))
    return apply_rules(ch, "profitability", rules, ok)


def benefit_insights(
    df: DataFrame,
    original: DataFrame | None = None,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    value_threshold: float = 1000.0,
    count_threshold: float = 100.0,
    roles: ColumnRoles | None = None,
    category: str = K.FOCUS_CATEGORY,
    home_category: str = K.BENEFIT_HOME_CATEGORY,
) -> DataFrame:
    """INS-2 (+ INS-6): benefit usage rules, given only when the latest year's
    revenue is > 0; with no benefit line at all, one status row explains it
    (naming the benefit's home category when the selection lacks it)."""
    r = roles_of(df, roles, "date", "subcategory", "price")
    out = benefit_rules(benefit_changes_with_revenue(df, pattern, as_of, r), value_threshold, count_threshold)
    return out.unionByName(benefit_status(df, original, pattern, r, category, home_category))


def benefit_rules(
    changes_with_revenue: DataFrame, value_threshold: float = 1000.0, count_threshold: float = 100.0
) -> DataFrame:
    """INS-2 over a YOY-5 change row that carries ``cur_total_revenue``."""
    ch = changes_with_revenue.where(F.col("cur_total_revenue") > 0)
    c = F.col
    rules = [
        Rule(c("value_change") < -value_threshold, "increased_usage", "alert",
             "More benefit value redeemed", F.abs(c("value_change"))),
        Rule(c("value_change") > value_threshold, "decreased_usage", "positive",
             "Less benefit value redeemed", c("value_change")),
        Rule(c("count_change") > count_threshold, "more_members", "info",
             "More benefit redemptions", c("count_change")),
        Rule(c("count_change") < -count_threshold, "fewer_members", "info",
             "Fewer benefit redemptions", F.abs(c("count_change"))),
    ]
    return apply_rules(ch, "benefits", rules)


def benefit_status(
    df: DataFrame,
    original: DataFrame | None = None,
    pattern: str = K.BENEFIT_PATTERN,
    roles: ColumnRoles | None = None,
    category: str = K.FOCUS_CATEGORY,
    home_category: str = K.BENEFIT_HOME_CATEGORY,
) -> DataFrame:
    """INS-6: one row when the input has no benefit line, else none; it names
    the benefit's home category when the selection holds ``category`` alone."""
    r = roles_of(df, roles, "subcategory")
    aggs = [F.count(F.when(is_benefit(r.subcategory, pattern), F.lit(1))).alias("n")]
    rules = [
        Rule(c_eq0(), "no_benefit_data", "info", "No benefit lines in the current data", F.lit(None)),
    ]
    with_scope = original is not None and r.category is not None
    if with_scope:
        cat = F.col(r.category).cast("string")
        aggs += [
            F.count_distinct(cat).alias("k"),
            F.coalesce(F.max((cat == F.lit(category)).cast("int")), F.lit(0)).alias("has_focus"),
            F.coalesce(F.max((cat == F.lit(home_category)).cast("int")), F.lit(0)).alias("has_home"),
        ]
    one = df.agg(*aggs)  # one pass over the input for every flag
    if with_scope:
        k_all = original.agg(F.count_distinct(cat)).scalar()
        one = one.withColumn("subset", F.col("k") < k_all)
        hint = c_eq0() & F.col("subset") & (F.col("has_focus") == 1) & (F.col("has_home") == 0)
        rules = [
            Rule(hint, "benefit_home_category_missing", "info",
                 f"Benefit lines exist only in {home_category}; it is not selected", F.lit(None)),
            Rule(c_eq0() & ~hint, "no_benefit_data", "info", "No benefit lines in the current data", F.lit(None)),
        ]
    return apply_rules(one, "benefits", rules)


def c_eq0() -> Column:
    return F.col("n") == 0


def penetration_insights(
    df: DataFrame,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    change_pp: float = 2.0,
    high_rate: float = 15.0,
    low_rate: float = 5.0,
    value_threshold: float = 1000.0,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """INS-3 / INS-4: engagement and penetration-level rules; 'double impact'
    when the rate rose and benefit value fell past the threshold (missing
    value change -> rule false)."""
    ch = penetration_changes(df, pattern, as_of, roles)
    vc = benefit_changes(df, pattern, as_of, roles).select("value_change").scalar()
    return penetration_rules(ch, vc, change_pp, high_rate, low_rate, value_threshold)


def penetration_rules(
    changes: DataFrame,
    value_change: Column,
    change_pp: float = 2.0,
    high_rate: float = 15.0,
    low_rate: float = 5.0,
    value_threshold: float = 1000.0,
) -> DataFrame:
    """INS-3 / INS-4 over a YOY-7 change row and the YOY-5 value change
    (a scalar column; null when there is none)."""
    # Without a benefit invoice in either year there is nothing to tell.
    ch = changes.where((F.col("current_rate") > 0) | (F.col("rate_change") != 0)).withColumn("value_change", value_change)
    c = F.col
    rules = [
        Rule(c("rate_change") > change_pp, "higher_engagement", "info",
             "More transactions used benefits", c("rate_change")),
        Rule(c("rate_change") < -change_pp, "lower_engagement", "info",
             "Fewer transactions used benefits", F.abs(c("rate_change"))),
        Rule(c("current_rate") > high_rate, "high_penetration", "positive",
             "High share of transactions use benefits", c("current_rate")),
        Rule(c("current_rate") < low_rate, "low_penetration", "warning",
             "Low share of transactions use benefits", c("current_rate")),
        Rule((c("rate_change") > change_pp) & (c("value_change") < -value_threshold), "double_impact", "alert",
             "More customers use benefits and redeem more value", c("rate_change")),
    ]
    return apply_rules(ch, "penetration", rules)


def category_insights(
    df: DataFrame,
    category: str = K.FOCUS_CATEGORY,
    pattern: str = K.BENEFIT_PATTERN,
    as_of=None,
    change_pp: float = 1.0,
    good_rate: float = 10.0,
    low_rate: float = 5.0,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """INS-5: benefit adoption rules within one category."""
    ch = category_penetration_change(df, category, pattern, as_of, roles)
    return category_rules(ch, change_pp, good_rate, low_rate)


def category_rules(
    ch: DataFrame, change_pp: float = 1.0, good_rate: float = 10.0, low_rate: float = 5.0
) -> DataFrame:
    """INS-5 over a YOY-8 change row."""
    c = F.col
    rules = [
        Rule(c("penetration_change") > change_pp, "more_category_customers", "info",
             "More category customers use benefits", c("penetration_change")),
        Rule(c("penetration_change") < -change_pp, "fewer_category_customers", "info",
             "Fewer category customers use benefits", F.abs(c("penetration_change"))),
        Rule(c("current_rate") > good_rate, "good_category_adoption", "positive",
             "Good benefit adoption in the category", c("current_rate")),
        Rule(c("current_rate") < low_rate, "low_category_adoption", "warning",
             "Low benefit adoption in the category", c("current_rate")),
    ]
    return apply_rules(ch, "category", rules)
