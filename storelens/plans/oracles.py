"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every statement runs on the raw test tables (pre-registered views) and
re-derives the purchases fact with the same text as FIXTURES.md §A.
Rounding uses ``round_even`` (NumPy-style half-even on doubles); column
names and types are aliased to match the Spark side exactly.
"""

from __future__ import annotations

from ..sources.star import PURCHASES_NULLS_SQL, PURCHASES_SQL


def _with(body: str, nulls: bool = False) -> str:
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ",\n" + body[5:]
    else:
        body = "\n" + body
    if nulls:
        return (
            f"WITH purchases AS ({PURCHASES_SQL}),\n"
            f"purchases_n AS ({PURCHASES_NULLS_SQL})"
            + body.replace("FROM purchases", "FROM purchases_n")
        )
    return f"WITH purchases AS ({PURCHASES_SQL}){body}"


# Reusable SQL fragments mirroring storelens.functions.exprs.
PRICE = "purchase_price_w_discount"
MSUM = f"cast(coalesce(sum({PRICE}), 0) AS DOUBLE)"
CSUM = "cast(coalesce(sum(unit_cost), 0) AS DOUBLE)"
MEAN = f"cast(sum({PRICE}) AS DOUBLE) / nullif(count({PRICE}), 0)"
WEEK = "cast(cast(purchase_date AS DATE) + cast(7 - isodow(purchase_date) AS INTEGER) AS TIMESTAMP)"
HOUR = "cast(hour(purchase_date) AS INTEGER)"
DAYPART = (
    "CASE WHEN {h} >= 5 AND {h} < 12 THEN 'Morning (5AM-12PM)' "
    "WHEN {h} >= 12 AND {h} < 17 THEN 'Afternoon (12PM-5PM)' "
    "WHEN {h} >= 17 AND {h} < 21 THEN 'Evening (5PM-9PM)' "
    "ELSE 'Night (9PM-5AM)' END"
)


def pct(num: str, den: str, digits: int | None = None) -> str:
    e = f"(CASE WHEN cast({den} AS DOUBLE) = 0 THEN NULL ELSE cast({num} AS DOUBLE) / cast({den} AS DOUBLE) END) * 100.0"
    return f"round_even({e}, {digits})" if digits is not None else e


ORACLES: dict[str, str] = {}


def _reg(name: str, body: str, nulls: bool = False) -> None:
    ORACLES[name] = _with(body, nulls)


_KPIS = f"""SELECT {MSUM} AS total_sales, count(*) AS transactions,
       {MSUM} / nullif(count(*), 0) AS avg_basket
FROM purchases"""
_reg("sales_kpis", _KPIS)
_reg("sales_kpis_nulls", _KPIS, nulls=True)

_reg(
    "profit_kpis",
    f"""SELECT total_sales, total_cogs, gross_profit,
       CASE WHEN total_sales > 0 THEN gross_profit / total_sales * 100.0 ELSE 0.0 END AS profit_margin
FROM (SELECT {MSUM} AS total_sales, {CSUM} AS total_cogs,
             cast(coalesce(sum({PRICE}), 0) - coalesce(sum(unit_cost), 0) AS DOUBLE) AS gross_profit
      FROM purchases)""",
)

_reg(
    "date_extent",
    """SELECT min(purchase_date) AS min_date, max(purchase_date) AS max_date,
       cast(cast(min(purchase_date) AS DATE) AS TIMESTAMP) AS min_day, cast(cast(max(purchase_date) AS DATE) AS TIMESTAMP) AS max_day
FROM purchases""",
)

_reg(
    "weekly_sales",
    f"""WITH w AS (SELECT {WEEK} AS week_ending, {MSUM} AS sales
           FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1),
cal AS (SELECT cast(unnest(generate_series(min(week_ending), max(week_ending), INTERVAL 7 DAY)) AS TIMESTAMP) AS week_ending FROM w)
SELECT cal.week_ending, coalesce(w.sales, 0.0) AS sales FROM cal LEFT JOIN w USING (week_ending)""",
)

_WK_LOC = f"""SELECT {WEEK} AS week_ending, store_location, {MSUM} AS sales
FROM purchases WHERE purchase_date IS NOT NULL AND store_location IS NOT NULL GROUP BY 1, 2"""
_reg("weekly_sales_by_location", _WK_LOC)
_reg("weekly_sales_by_location_nulls", _WK_LOC, nulls=True)

_reg(
    "top_locations",
    f"""SELECT store_location, {MSUM} AS sales FROM purchases WHERE store_location IS NOT NULL
GROUP BY 1 ORDER BY sales DESC NULLS LAST, store_location LIMIT 10""",
)

_SUB_PROFIT = f"""SELECT revenue_subcategory, revenue, cogs, profit, {pct('profit', 'revenue', 1)} AS profit_margin_pct
FROM (SELECT revenue_subcategory, {MSUM} AS revenue, {CSUM} AS cogs,
             cast(coalesce(sum({PRICE}), 0) - coalesce(sum(unit_cost), 0) AS DOUBLE) AS profit
      FROM purchases WHERE revenue_subcategory IS NOT NULL GROUP BY 1)
ORDER BY profit DESC NULLS LAST, revenue_subcategory"""
_reg("profit_by_subcategory", _SUB_PROFIT)
_reg("profit_by_subcategory_top15", _SUB_PROFIT + " LIMIT 15")

_MONTHLY = f"""SELECT year, month, year_month, cast(rev AS DOUBLE) AS revenue, cast(cst AS DOUBLE) AS cost,
       cast(rev - cst AS DOUBLE) AS profit, {pct('rev - cst', 'rev', 2)} AS profit_margin
FROM (SELECT cast(year(purchase_date) AS INTEGER) AS year, cast(month(purchase_date) AS INTEGER) AS month,
             strftime(purchase_date, '%Y-%m') AS year_month,
             coalesce(sum({PRICE}), 0) AS rev, coalesce(sum(unit_cost), 0) AS cst
      FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1, 2, 3)
WHERE rev > 0"""
_reg("monthly_profit", _MONTHLY)
_reg("monthly_profit_nulls", _MONTHLY, nulls=True)

_reg(
    "quarterly_profit",
    f"""SELECT year, quarter, year_quarter, cast(rev AS DOUBLE) AS revenue, cast(cst AS DOUBLE) AS cost,
       cast(rev - cst AS DOUBLE) AS profit, {pct('rev - cst', 'rev', 2)} AS profit_margin
FROM (SELECT cast(year(purchase_date) AS INTEGER) AS year, cast(quarter(purchase_date) AS INTEGER) AS quarter,
             printf('%d Q%d', year(purchase_date), quarter(purchase_date)) AS year_quarter,
             coalesce(sum({PRICE}), 0) AS rev, coalesce(sum(unit_cost), 0) AS cst
      FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1, 2, 3)""",
)

_SUBSALES = f"""SELECT revenue_subcategory, {MSUM} AS total_sales, count({PRICE}) AS transaction_count,
       {MSUM} / nullif(cast(count({PRICE}) AS DOUBLE), 0) AS average_transaction
FROM purchases WHERE revenue_subcategory IS NOT NULL GROUP BY 1
ORDER BY total_sales DESC NULLS LAST, revenue_subcategory"""
_reg("subcategory_sales", _SUBSALES)
_reg("subcategory_sales_top10", _SUBSALES + " LIMIT 10")
_reg("subcategory_sales_nulls", _SUBSALES, nulls=True)

_HOURLY = f"""SELECT {HOUR} AS hour, {MSUM} AS total_sales, count({PRICE}) AS transaction_count,
       {MEAN} AS avg_transaction, {DAYPART.format(h=HOUR)} AS time_period,
       printf('%02d:00', {HOUR}) AS hour_display
FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1"""
_reg("hourly_sales", _HOURLY)

_DAYPART = f"""SELECT {DAYPART.format(h=HOUR)} AS time_period, {MSUM} AS total_sales, count({PRICE}) AS transaction_count
FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1"""
_reg("daypart_sales", _DAYPART)

_reg(
    "weekday_sales",
    f"""SELECT dayname(purchase_date) AS day_of_week, cast(isodow(purchase_date) - 1 AS INTEGER) AS day_num,
       {MSUM} AS total_sales, count({PRICE}) AS transaction_count
FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1, 2""",
)

_reg(
    "peak_time",
    f"""WITH h AS ({_HOURLY}), d AS ({_DAYPART}),
bh AS (SELECT * FROM h ORDER BY total_sales DESC, hour LIMIT 1),
bp AS (SELECT * FROM d ORDER BY total_sales DESC, time_period LIMIT 1)
SELECT bh.hour AS best_hour, printf('%d:00', bh.hour) AS best_hour_label, bh.total_sales AS best_hour_sales,
       bh.transaction_count AS peak_hour_transactions, bh.avg_transaction AS avg_per_transaction,
       split_part(bp.time_period, ' ', 1) AS best_period
FROM bh CROSS JOIN bp""",
)


# ---------------------------------------------------------------------------
# filters, options and filtered KPIs
CMEAN = "cast(sum(unit_cost) AS DOUBLE) / nullif(count(unit_cost), 0)"
ISBEN = "coalesce(contains(lower(revenue_subcategory), 'brand#25'), false)"
ASOF = "(SELECT max(purchase_date) FROM purchases)"
YTD = (
    f"purchase_date IS NOT NULL AND (month(purchase_date) < month({ASOF}) OR "
    f"(month(purchase_date) = month({ASOF}) AND day(purchase_date) <= day({ASOF})))"
)
YEAR = "cast(year(purchase_date) AS INTEGER)"


def kpis_where(where: str) -> str:
    return f"""SELECT {MSUM} AS total_sales, count(*) AS transactions,
       {MSUM} / nullif(count(*), 0) AS avg_basket
FROM purchases WHERE {where}"""


_FIRST5_CAT = "(SELECT o FROM (SELECT DISTINCT cast(disp_category AS VARCHAR) AS o FROM purchases WHERE disp_category IS NOT NULL) ORDER BY o LIMIT 5)"
_reg(
    "scope_summary",
    f"""SELECT count(*) AS total_records, count(DISTINCT disp_category) AS categories,
       (SELECT count(DISTINCT disp_category) FROM purchases) AS all_categories,
       count(DISTINCT disp_category) < (SELECT count(DISTINCT disp_category) FROM purchases) AS is_subset
FROM purchases WHERE cast(disp_category AS VARCHAR) IN {_FIRST5_CAT}""",
)
_reg(
    "selected_categories",
    f"""SELECT string_agg(c, ', ' ORDER BY c) AS categories
FROM (SELECT DISTINCT cast(disp_category AS VARCHAR) AS c FROM purchases
      WHERE disp_category IS NOT NULL AND cast(disp_category AS VARCHAR) IN {_FIRST5_CAT})""",
)


def options(col: str, where: str = "TRUE", limit: str = "") -> str:
    return f"""SELECT DISTINCT cast({col} AS VARCHAR) AS option FROM purchases
WHERE {col} IS NOT NULL AND {where} ORDER BY option {limit}"""


_reg("location_options", options("store_location"))
_reg("category_options", options("disp_category"))
_reg("subcategory_options", options("revenue_subcategory", "cast(disp_category AS VARCHAR) IN ('STANDARD', 'SMALL')"))
_reg("default_location_selection", options("store_location", limit="LIMIT 5"))
_reg("default_category_selection", options("disp_category", limit="LIMIT 5"))
_reg("date_range_kpis", kpis_where("purchase_date >= TIMESTAMP '1997-01-01' AND purchase_date <= TIMESTAMP '1998-12-31'"))
_reg("date_range_day_kpis", kpis_where("purchase_date >= TIMESTAMP '1997-01-01' AND purchase_date < TIMESTAMP '1999-01-01'"))
_ALL_TIME = (
    "purchase_date >= (SELECT cast(cast(min(purchase_date) AS DATE) AS TIMESTAMP) FROM purchases) "
    "AND purchase_date <= (SELECT cast(cast(max(purchase_date) AS DATE) AS TIMESTAMP) FROM purchases)"
)
_reg("all_time_kpis", kpis_where(_ALL_TIME))
for _n in (30, 90):
    _reg(
        f"last_{_n}_days_kpis",
        kpis_where(
            f"purchase_date >= (SELECT cast(cast(max(purchase_date) AS DATE) AS TIMESTAMP) - INTERVAL {_n} DAY FROM purchases) "
            "AND purchase_date <= (SELECT cast(cast(max(purchase_date) AS DATE) AS TIMESTAMP) FROM purchases)"
        ),
    )
_reg("location_filter_kpis", kpis_where("cast(store_location AS VARCHAR) IN ('NATION_3', 'NATION_7', 'NATION_11')"))
_reg("category_filter_kpis", kpis_where("cast(disp_category AS VARCHAR) IN ('STANDARD', 'SMALL')"))
_reg(
    "subcategory_filter_kpis",
    kpis_where(
        "cast(disp_category AS VARCHAR) IN ('STANDARD', 'SMALL') "
        "AND cast(revenue_subcategory AS VARCHAR) IN ('Brand#1', 'Brand#2', 'Brand#25')"
    ),
)
_DEFAULT_VIEW = (
    f"{_ALL_TIME} AND cast(store_location AS VARCHAR) IN (SELECT o FROM (SELECT DISTINCT cast(store_location AS VARCHAR) AS o "
    f"FROM purchases WHERE store_location IS NOT NULL AND {_ALL_TIME}) ORDER BY o LIMIT 5) "
    f"AND cast(disp_category AS VARCHAR) IN {_FIRST5_CAT}"
)
_reg("default_view_kpis", kpis_where(_DEFAULT_VIEW))
_reg(
    "default_view_profit_kpis",
    f"""SELECT total_sales, total_cogs, gross_profit,
       CASE WHEN total_sales > 0 THEN gross_profit / total_sales * 100.0 ELSE 0.0 END AS profit_margin
FROM (SELECT {MSUM} AS total_sales, {CSUM} AS total_cogs,
             cast(coalesce(sum({PRICE}), 0) - coalesce(sum(unit_cost), 0) AS DOUBLE) AS gross_profit
      FROM purchases WHERE {_DEFAULT_VIEW})""",
)
_reg("year_to_date_kpis", kpis_where(YTD))
_reg(
    "subcategory_sales_ex_benefit",
    f"""SELECT revenue_subcategory, {MSUM} AS total_sales, count({PRICE}) AS transaction_count,
       {MSUM} / nullif(cast(count({PRICE}) AS DOUBLE), 0) AS average_transaction
FROM purchases WHERE revenue_subcategory IS NOT NULL AND NOT {ISBEN} GROUP BY 1""",
)

# ---------------------------------------------------------------------------
# YTD / YoY


def chg(cur: str, prev: str) -> str:
    return f"(CASE WHEN cast({prev} AS DOUBLE) = 0 THEN NULL ELSE cast({cur} AS DOUBLE) / cast({prev} AS DOUBLE) END - 1.0) * 100.0"


def latest_two(table: str) -> str:
    """Join the latest (c) and previous (p) year rows of ``table``."""
    return f"""(SELECT max(year) AS cur_year, min(year) AS prev_year, count(*) AS n
       FROM (SELECT year FROM {table} ORDER BY year DESC LIMIT 2)) two
JOIN {table} c ON c.year = two.cur_year JOIN {table} p ON p.year = two.prev_year
WHERE two.n = 2"""


YTD_METRICS = f"""SELECT year, total_revenue, avg_sale_price, transaction_count, total_cost, avg_unit_cost,
       total_revenue - total_cost AS total_profit,
       {pct('total_revenue - total_cost', 'total_revenue', 2)} AS profit_margin,
       round_even((total_revenue - total_cost) / nullif(cast(transaction_count AS DOUBLE), 0), 2) AS avg_profit_per_sale
FROM (SELECT {YEAR} AS year, round_even({MSUM}, 2) AS total_revenue, round_even({MEAN}, 2) AS avg_sale_price,
             count({PRICE}) AS transaction_count, round_even({CSUM}, 2) AS total_cost,
             round_even({CMEAN}, 2) AS avg_unit_cost
      FROM purchases WHERE {YTD} GROUP BY 1)"""
_reg("ytd_metrics", YTD_METRICS)

YTD_CHANGES = f"""WITH ym AS ({YTD_METRICS})
SELECT two.prev_year, two.cur_year,
       {chg('c.total_revenue', 'p.total_revenue')} AS revenue_change,
       {chg('c.total_cost', 'p.total_cost')} AS cost_change,
       {chg('c.avg_sale_price', 'p.avg_sale_price')} AS avg_price_change,
       {chg('c.avg_unit_cost', 'p.avg_unit_cost')} AS avg_cost_change,
       {chg('c.transaction_count', 'p.transaction_count')} AS transaction_change
FROM {latest_two('ym')}"""
_reg("ytd_changes", YTD_CHANGES)

QUARTERLY = f"""SELECT year, quarter, year_quarter, cast(rev AS DOUBLE) AS revenue, cast(cst AS DOUBLE) AS cost,
       cast(rev - cst AS DOUBLE) AS profit, {pct('rev - cst', 'rev', 2)} AS profit_margin
FROM (SELECT cast(year(purchase_date) AS INTEGER) AS year, cast(quarter(purchase_date) AS INTEGER) AS quarter,
             printf('%d Q%d', year(purchase_date), quarter(purchase_date)) AS year_quarter,
             coalesce(sum({PRICE}), 0) AS rev, coalesce(sum(unit_cost), 0) AS cst
      FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1, 2, 3)"""

for _v, _name in (("profit", "quarter_year_pivot_profit"), ("profit_margin", "quarter_year_pivot_margin")):
    _cells = ", ".join(f"coalesce(max(CASE WHEN year = {y} THEN {_v} END), 0.0) AS \"{y}\"" for y in range(1995, 2002))
    _reg(_name, f"WITH q AS ({QUARTERLY}) SELECT quarter, {_cells} FROM q GROUP BY quarter")

YOY_QUARTERLY = f"""WITH q AS (SELECT *, revenue = 0 AND profit <> 0 AS inf_margin FROM ({QUARTERLY})),
yrs AS (SELECT max(year) AS cur_year, min(year) AS prev_year, count(*) AS n
        FROM (SELECT DISTINCT year FROM q ORDER BY year DESC LIMIT 2)),
per AS (SELECT quarter,
               max(CASE WHEN year = prev_year THEN profit END) AS p_profit,
               max(CASE WHEN year = cur_year THEN profit END) AS c_profit,
               max(CASE WHEN year = prev_year THEN profit_margin END) AS p_margin,
               max(CASE WHEN year = cur_year THEN profit_margin END) AS c_margin,
               coalesce(bool_or(CASE WHEN year = prev_year THEN inf_margin END), false) AS p_inf,
               coalesce(bool_or(CASE WHEN year = cur_year THEN inf_margin END), false) AS c_inf
        FROM q CROSS JOIN yrs GROUP BY quarter),
quarters AS (SELECT cast(unnest([1, 2, 3, 4]) AS INTEGER) AS quarter),
t AS (SELECT 'Q' || cast(quarters.quarter AS VARCHAR) AS quarter, yrs.prev_year, yrs.cur_year,
             coalesce(p_profit, 0.0) AS prev_profit, coalesce(c_profit, 0.0) AS cur_profit,
             coalesce(p_margin, 0.0) AS prev_margin, coalesce(c_margin, 0.0) AS cur_margin,
             coalesce(p_inf, false) OR coalesce(c_inf, false) AS inf
      FROM quarters CROSS JOIN yrs LEFT JOIN per ON per.quarter = quarters.quarter WHERE yrs.n = 2)
SELECT quarter, prev_year, cur_year, prev_profit, cur_profit, prev_margin, cur_margin,
       cur_profit - prev_profit AS profit_change,
       coalesce(round_even({chg('cur_profit', 'prev_profit')}, 1), 0.0) AS profit_change_pct,
       CASE WHEN inf THEN 0.0 ELSE cur_margin - prev_margin END AS margin_change
FROM t"""
_reg("yoy_quarterly", YOY_QUARTERLY)
for _m in ("profit", "margin"):
    _reg(
        f"yoy_quarterly_long_{_m}",
        f"""WITH y AS ({YOY_QUARTERLY.replace('WITH q AS', 'WITH q0 AS', 0)})
SELECT quarter, cast(prev_year AS VARCHAR) AS year, prev_{_m} AS value FROM y
UNION ALL SELECT quarter, cast(cur_year AS VARCHAR) AS year, cur_{_m} AS value FROM y""",
    )


def rules_sql(section: str, src: str, rules: list[tuple[str, str, str, str, str]], fallback=None) -> str:
    """UNION ALL of one SELECT per rule over the one-row ``src``."""
    parts = [
        f"SELECT '{section}' AS section, '{code}' AS code, '{sev}' AS severity, '{msg}' AS message, "
        f"cast({val} AS DOUBLE) AS value FROM {src} WHERE coalesce({cond}, false)"
        for cond, code, sev, msg, val in rules
    ]
    if fallback is not None:
        code, sev, msg = fallback
        none = " OR ".join(f"coalesce({r[0]}, false)" for r in rules)
        parts.append(
            f"SELECT '{section}', '{code}', '{sev}', '{msg}', cast(NULL AS DOUBLE) FROM {src} WHERE NOT ({none})"
        )
    return "\nUNION ALL ".join(parts)


_reg(
    "profitability_insights",
    f"""WITH ch AS ({YTD_CHANGES.replace('WITH ym AS', 'WITH ym0 AS', 0)})
"""
    + rules_sql(
        "profitability",
        "ch",
        [
            ("avg_cost_change > avg_price_change + 2.0", "cost_inflation", "alert",
             "Unit costs rose faster than selling prices", "avg_cost_change - avg_price_change"),
            ("transaction_change < -5.0", "volume_decline", "alert",
             "Transaction count dropped significantly", "transaction_change"),
            ("avg_price_change < -2.0", "price_pressure", "alert", "Average selling prices declined", "avg_price_change"),
            ("cost_change > revenue_change + 5.0", "cost_structure", "alert",
             "Total costs grew much faster than revenue", "cost_change - revenue_change"),
        ],
        ("no_red_flags", "ok", "Changes appear proportional"),
    ),
)

# ---------------------------------------------------------------------------
# member benefits
BEN_YTD = f"""SELECT year, tbv AS total_benefit_value, benefit_count, avg_benefit_value,
       tbc AS total_benefit_cost, tbv - tbc AS benefit_profit_impact
FROM (SELECT {YEAR} AS year, round_even({MSUM}, 2) AS tbv, count({PRICE}) AS benefit_count,
             round_even({MEAN}, 2) AS avg_benefit_value, round_even({CSUM}, 2) AS tbc
      FROM purchases WHERE {YTD} AND {ISBEN} GROUP BY 1)"""
_reg("benefit_ytd", BEN_YTD)
_reg(
    "benefit_monthly",
    f"""SELECT {YEAR} AS year, cast(month(purchase_date) AS INTEGER) AS month,
       strftime(purchase_date, '%Y-%m') AS year_month, {MSUM} AS benefit_value
FROM purchases WHERE purchase_date IS NOT NULL AND {ISBEN} GROUP BY 1, 2, 3""",
)
BEN_CHANGES = f"""WITH b AS ({BEN_YTD})
SELECT two.prev_year, two.cur_year,
       c.total_benefit_value - p.total_benefit_value AS value_change,
       c.benefit_count - p.benefit_count AS count_change,
       c.benefit_profit_impact - p.benefit_profit_impact AS profit_impact_change,
       abs(c.total_benefit_value - p.total_benefit_value) AS abs_value_change,
       CASE WHEN c.total_benefit_value - p.total_benefit_value < 0 THEN 'more' ELSE 'less' END AS direction
FROM {latest_two('b')}"""
_reg("benefit_changes", BEN_CHANGES)
BEN_SHARE = f"""WITH b AS ({BEN_YTD}), ym AS ({YTD_METRICS}),
two AS (SELECT max(year) AS cur_year, min(year) AS prev_year, count(*) AS n FROM (SELECT year FROM b ORDER BY year DESC LIMIT 2)),
s AS (SELECT two.prev_year, two.cur_year, coalesce(yp.total_revenue, 0.0) AS total_revenue_previous,
             coalesce(yc.total_revenue, 0.0) AS total_revenue_current,
             bp.total_benefit_value AS pv, bc.total_benefit_value AS cv
      FROM two JOIN b bc ON bc.year = two.cur_year JOIN b bp ON bp.year = two.prev_year
      LEFT JOIN ym yc ON yc.year = two.cur_year LEFT JOIN ym yp ON yp.year = two.prev_year
      WHERE two.n = 2)
SELECT prev_year, cur_year, total_revenue_previous, total_revenue_current,
       CASE WHEN total_revenue_previous > 0 THEN pv / total_revenue_previous * 100.0 ELSE 0.0 END AS share_previous,
       cv / total_revenue_current * 100.0 AS share_current
FROM s WHERE total_revenue_current > 0"""
_reg("benefit_revenue_share", BEN_SHARE)
_reg(
    "benefit_insights",
    f"""WITH ch AS ({BEN_CHANGES.replace('WITH b AS', 'WITH b0 AS', 0)}
               ),
sh AS ({BEN_SHARE}),
x AS (SELECT * FROM ch WHERE cur_year IN (SELECT cur_year FROM sh))
"""
    + rules_sql(
        "benefits",
        "x",
        [
            ("value_change < -1000.0", "increased_usage", "alert", "More benefit value redeemed", "abs(value_change)"),
            ("value_change > 1000.0", "decreased_usage", "positive", "Less benefit value redeemed", "value_change"),
            ("count_change > 100", "more_members", "info", "More benefit redemptions", "count_change"),
            ("count_change < -100", "fewer_members", "info", "Fewer benefit redemptions", "abs(count_change)"),
        ],
    )
    + f"""
UNION ALL SELECT 'benefits', 'no_benefit_data', 'info', 'No benefit lines in the current data', cast(NULL AS DOUBLE)
FROM (SELECT count(*) AS n FROM purchases WHERE {ISBEN}) WHERE n = 0""",
)
for _name, _cats, _focus, _home in (
    ("benefit_status_scoped", "'STANDARD', 'SMALL'", "Food", "ProShop"),
    ("benefit_status_hint", "'STANDARD'", "STANDARD", "SMALL"),
):
    _reg(
        _name,
        f"""WITH s AS (SELECT * FROM purchases WHERE cast(disp_category AS VARCHAR) IN ({_cats}) AND NOT {ISBEN}),
st AS (SELECT (SELECT count(*) FROM s WHERE {ISBEN}) AS n,
              (SELECT count(DISTINCT disp_category) FROM s) < (SELECT count(DISTINCT disp_category) FROM purchases) AS subset,
              (SELECT coalesce(max(CASE WHEN cast(disp_category AS VARCHAR) = '{_focus}' THEN 1 ELSE 0 END), 0) FROM s) AS has_focus,
              (SELECT coalesce(max(CASE WHEN cast(disp_category AS VARCHAR) = '{_home}' THEN 1 ELSE 0 END), 0) FROM s) AS has_home)
SELECT 'benefits' AS section,
       CASE WHEN subset AND has_focus = 1 AND has_home = 0 THEN 'benefit_home_category_missing' ELSE 'no_benefit_data' END AS code,
       'info' AS severity,
       CASE WHEN subset AND has_focus = 1 AND has_home = 0 THEN 'Benefit lines exist only in {_home}; it is not selected'
            ELSE 'No benefit lines in the current data' END AS message,
       cast(NULL AS DOUBLE) AS value
FROM st WHERE n = 0""",
    )
PEN = f"""SELECT {YEAR} AS year, count(DISTINCT invoice_id) AS total_invoices,
       count(DISTINCT CASE WHEN {ISBEN} THEN invoice_id END) AS benefit_invoices,
       CASE WHEN count(DISTINCT invoice_id) > 0
            THEN cast(count(DISTINCT CASE WHEN {ISBEN} THEN invoice_id END) AS DOUBLE) / count(DISTINCT invoice_id) * 100.0
            ELSE 0.0 END AS penetration_rate
FROM purchases WHERE {YTD} GROUP BY 1"""
_reg("benefit_penetration", PEN)
_reg("benefit_penetration_nulls", PEN, nulls=True)
PEN_CHANGES = f"""WITH pe AS ({PEN})
SELECT two.prev_year, two.cur_year, c.penetration_rate AS current_rate, p.penetration_rate AS previous_rate,
       c.penetration_rate - p.penetration_rate AS rate_change, c.benefit_invoices AS current_benefit_invoices,
       c.benefit_invoices - p.benefit_invoices AS invoices_change
FROM {latest_two('pe')}"""
_reg("penetration_changes", PEN_CHANGES)
_reg(
    "penetration_insights",
    f"""WITH ch0 AS ({PEN_CHANGES}), bc AS ({BEN_CHANGES}),
ch AS (SELECT *, (SELECT value_change FROM bc) AS value_change FROM ch0)
"""
    + rules_sql(
        "penetration",
        "ch",
        [
            ("rate_change > 2.0", "higher_engagement", "info", "More transactions used benefits", "rate_change"),
            ("rate_change < -2.0", "lower_engagement", "info", "Fewer transactions used benefits", "abs(rate_change)"),
            ("current_rate > 15.0", "high_penetration", "positive", "High share of transactions use benefits", "current_rate"),
            ("current_rate < 5.0", "low_penetration", "warning", "Low share of transactions use benefits", "current_rate"),
            ("rate_change > 2.0 AND value_change < -1000.0", "double_impact", "alert",
             "More customers use benefits and redeem more value", "rate_change"),
        ],
    ),
)
CAT_LINES = f"{YTD} AND disp_category = 'STANDARD'"
BEN_INV = f"(SELECT invoice_id FROM purchases WHERE {ISBEN} AND invoice_id IS NOT NULL)"
_reg(
    "category_with_benefit",
    f"""SELECT {YEAR} AS year, round_even({MSUM}, 2) AS category_value_with_benefit, count({PRICE}) AS category_items_count,
       round_even({MEAN}, 2) AS avg_category_item_value, count(DISTINCT invoice_id) AS category_invoices_with_benefit
FROM purchases WHERE {CAT_LINES} AND invoice_id IN {BEN_INV} GROUP BY 1""",
)
_reg(
    "category_ytd",
    f"""SELECT {YEAR} AS year, count(DISTINCT invoice_id) AS total_category_invoices, {MSUM} AS total_category_sales
FROM purchases WHERE {CAT_LINES} GROUP BY 1""",
)
CAT_PEN = f"""SELECT {YEAR} AS year, count(DISTINCT invoice_id) AS total_category_invoices,
       count(DISTINCT CASE WHEN invoice_id IN {BEN_INV} THEN invoice_id END) AS category_invoices_with_benefit,
       CASE WHEN count(DISTINCT invoice_id) > 0
            THEN cast(count(DISTINCT CASE WHEN invoice_id IN {BEN_INV} THEN invoice_id END) AS DOUBLE) / count(DISTINCT invoice_id) * 100.0
            ELSE 0.0 END AS category_penetration
FROM purchases WHERE {CAT_LINES} GROUP BY 1
HAVING count(DISTINCT CASE WHEN invoice_id IN {BEN_INV} THEN invoice_id END) > 0"""
_reg("category_benefit_penetration", CAT_PEN)
CAT_PEN_CHANGE = f"""WITH cp AS ({CAT_PEN})
SELECT two.prev_year, two.cur_year, c.category_penetration AS current_rate, p.category_penetration AS previous_rate,
       c.category_penetration - p.category_penetration AS penetration_change
FROM {latest_two('cp')}"""
_reg("category_penetration_change", CAT_PEN_CHANGE)
_reg(
    "category_insights",
    f"""WITH ch AS ({CAT_PEN_CHANGE})
"""
    + rules_sql(
        "category",
        "ch",
        [
            ("penetration_change > 1.0", "more_category_customers", "info",
             "More category customers use benefits", "penetration_change"),
            ("penetration_change < -1.0", "fewer_category_customers", "info",
             "Fewer category customers use benefits", "abs(penetration_change)"),
            ("current_rate > 10.0", "good_category_adoption", "positive", "Good benefit adoption in the category", "current_rate"),
            ("current_rate < 5.0", "low_category_adoption", "warning", "Low benefit adoption in the category", "current_rate"),
        ],
    ),
)

# ---------------------------------------------------------------------------
# products
PRODUCT_STATS = f"""SELECT revenue_subcategory, product_name, round_even(coalesce(sum(quantity), 0.0), 2) AS total_quantity,
       round_even({MSUM}, 2) AS total_sales, round_even({MEAN}, 2) AS avg_price,
       count(DISTINCT invoice_id) AS unique_transactions
FROM purchases WHERE revenue_subcategory IS NOT NULL AND product_name IS NOT NULL GROUP BY 1, 2"""
_reg("product_stats", PRODUCT_STATS)
HIGHLIGHTS = f"""WITH top AS (SELECT revenue_subcategory AS category, {MSUM} AS category_sales FROM purchases
             WHERE revenue_subcategory IS NOT NULL AND NOT {ISBEN}
             GROUP BY 1 ORDER BY category_sales DESC NULLS LAST, category LIMIT 10),
ranked AS (SELECT *, cast(row_number() OVER (ORDER BY category_sales DESC, category) AS INTEGER) AS rank FROM top),
ps AS ({PRODUCT_STATS}),
best AS (SELECT *, row_number() OVER (PARTITION BY revenue_subcategory ORDER BY total_quantity DESC, product_name) AS rn
         FROM ps WHERE revenue_subcategory IN (SELECT category FROM top))
SELECT r.rank, r.category, b.product_name AS product, cast(trunc(b.total_quantity) AS BIGINT) AS qty_sold,
       b.total_sales, '$' || format('{{:,.0f}}', b.total_sales) AS total_sales_text,
       b.avg_price, printf('$%.2f', b.avg_price) AS avg_price_text, b.unique_transactions AS transactions,
       r.category_sales, '$' || format('{{:,.0f}}', r.category_sales) AS category_sales_text
FROM ranked r JOIN best b ON b.revenue_subcategory = r.category AND b.rn = 1"""
_reg("product_highlights", HIGHLIGHTS)
_reg("product_highlights_nulls", HIGHLIGHTS, nulls=True)
_reg(
    "highlight_leaders",
    f"""WITH h AS ({HIGHLIGHTS.replace('WITH top AS', 'WITH top AS', 1)})
(SELECT 'best_seller' AS leader, category, product, cast(qty_sold AS DOUBLE) AS value FROM h ORDER BY qty_sold DESC, rank LIMIT 1)
UNION ALL (SELECT 'top_revenue', category, product, round_even(total_sales, 0) FROM h ORDER BY round_even(total_sales, 0) DESC, rank LIMIT 1)
UNION ALL (SELECT 'most_popular', category, product, cast(transactions AS DOUBLE) FROM h ORDER BY transactions DESC, rank LIMIT 1)""",
)

# ---------------------------------------------------------------------------
# vendors
VENDORS = f"""SELECT vendor_name, total_sales, transaction_count, avg_transaction, total_cost, profit,
       {pct('profit', 'total_sales', 1)} AS profit_margin
FROM (SELECT vendor_name, {MSUM} AS total_sales, count({PRICE}) AS transaction_count, {MEAN} AS avg_transaction,
             {CSUM} AS total_cost, cast(coalesce(sum({PRICE}), 0) - coalesce(sum(unit_cost), 0) AS DOUBLE) AS profit
      FROM purchases WHERE vendor_name IS NOT NULL GROUP BY 1)"""
_reg("vendor_performance", VENDORS)
_reg("vendor_performance_nulls", VENDORS, nulls=True)
CONC = f"""WITH pv AS (SELECT vendor_name, coalesce(sum({PRICE}), 0) AS s FROM purchases WHERE vendor_name IS NOT NULL GROUP BY 1),
top AS (SELECT * FROM pv ORDER BY s DESC, vendor_name LIMIT 1),
t5 AS (SELECT cast(coalesce(sum(s), 0) AS DOUBLE) AS t FROM (SELECT s FROM pv ORDER BY s DESC, vendor_name LIMIT 5)),
tot AS (SELECT {MSUM} AS total FROM purchases)
SELECT (SELECT count(*) FROM pv) AS total_vendors,
       CASE WHEN length(top.vendor_name) > 15 THEN substr(top.vendor_name, 1, 15) || '...' ELSE top.vendor_name END AS top_vendor,
       cast(top.s AS DOUBLE) AS top_vendor_sales, t5.t AS top5_sales,
       CASE WHEN tot.total > 0 THEN t5.t / tot.total * 100.0 ELSE 0.0 END AS top5_share
FROM top, t5, tot"""
_reg("vendor_concentration", CONC)
_reg("vendor_concentration_nulls", CONC, nulls=True)


def top_vendors_sql(by: str, n: int, min_txns: int = 0, cols: str = "*") -> str:
    return f"""WITH v AS ({VENDORS})
SELECT {cols} FROM v WHERE transaction_count >= {min_txns} ORDER BY {by} DESC NULLS LAST, vendor_name LIMIT {n}"""


_reg("top_vendors_by_sales", top_vendors_sql("total_sales", 15))
_reg("top_vendors_by_count", top_vendors_sql("transaction_count", 15))
_reg("top_vendors_by_profit", top_vendors_sql("profit", 15))
_reg("top_vendors_by_margin", top_vendors_sql("profit_margin", 15, 10))
_reg("top_vendors_by_avg", top_vendors_sql("avg_transaction", 15, 5))
_reg("vendor_scatter", top_vendors_sql("total_sales", 20))
_reg(
    "vendor_detail",
    top_vendors_sql("total_sales", 30, cols="vendor_name, total_sales, transaction_count, avg_transaction, profit, profit_margin"),
)

# ---------------------------------------------------------------------------
# sources, cleaning, sinks
_reg(
    "preprocess_roundtrip",
    f"""SELECT purchase_date, invoice_id, cast({PRICE} AS DOUBLE) AS {PRICE}, cast(unit_cost AS VARCHAR) AS unit_cost
FROM purchases""",
)
_reg("canonical_roundtrip", "SELECT * FROM purchases")
ORACLES["checkins_clean"] = "SELECT * FROM events"
_reg(
    "sample_rows",
    """SELECT * REPLACE (cast(purchase_price_w_discount AS DOUBLE) AS purchase_price_w_discount,
                   cast(unit_cost AS DOUBLE) AS unit_cost)
FROM purchases ORDER BY purchase_date NULLS FIRST, invoice_id NULLS FIRST, store_location NULLS FIRST,
disp_category NULLS FIRST, revenue_subcategory NULLS FIRST, product_name NULLS FIRST, vendor_name NULLS FIRST,
quantity NULLS FIRST, purchase_price_w_discount NULLS FIRST, unit_cost NULLS FIRST LIMIT 100""",
)
_reg(
    "ytd_window",
    """SELECT max(purchase_date) AS as_of, cast(cast(max(purchase_date) AS DATE) AS TIMESTAMP) AS as_of_day,
       strftime(max(purchase_date), '%B %d') AS as_of_label,
       cast(month(max(purchase_date)) * 100 + day(max(purchase_date)) AS INTEGER) AS month_day
FROM purchases""",
)
_reg(
    "yoy_readiness",
    f"""SELECT months_with_revenue, years, months_with_revenue >= 2 AND years >= 2 AS ready
FROM (SELECT count(*) FILTER (WHERE rev > 0) AS months_with_revenue, count(DISTINCT year) AS years
      FROM (SELECT year(purchase_date) AS year, month(purchase_date) AS month, coalesce(sum({PRICE}), 0) AS rev
            FROM purchases WHERE purchase_date IS NOT NULL GROUP BY 1, 2))""",
)

# The calendar-cube derivations must return exactly what the operators return.
CUBE_TWINS = (
    "sales_kpis", "sales_kpis_nulls", "profit_kpis", "weekly_sales", "monthly_profit", "monthly_profit_nulls",
    "quarterly_profit", "hourly_sales", "daypart_sales", "weekday_sales", "peak_time", "ytd_metrics",
    "ytd_changes", "benefit_ytd", "benefit_changes", "benefit_revenue_share", "benefit_monthly",
)
for _name in CUBE_TWINS:
    ORACLES[_name + "_via_cube"] = ORACLES[_name]

# Dirty text: what each date form keeps (whole day, minute or second), and the prices that are plain numbers.
_reg("dirty_purchases", """SELECT invoice_id % 8 AS form, count(*) AS rows, count(d) AS dates, min(d) AS first_date, max(d) AS last_date,
       count(p) AS prices, cast(sum(cast(p * 100 AS BIGINT)) AS BIGINT) AS cents
FROM (SELECT invoice_id,
             CASE WHEN invoice_id % 8 IN (1, 4) THEN cast(date_trunc('day', purchase_date) AS TIMESTAMP)
                  WHEN invoice_id % 8 IN (2, 7) THEN date_trunc('minute', purchase_date)
                  WHEN invoice_id % 8 = 6 THEN NULL ELSE purchase_date END AS d,
             CASE WHEN invoice_id % 7 IN (0, 4) THEN purchase_price_w_discount END AS p
      FROM purchases) GROUP BY 1""")
_reg("dirty_losses", """SELECT 'purchase_date' AS "column", count(*) AS texts, count(*) FILTER (invoice_id % 8 <> 6) AS parsed,
       count(*) FILTER (invoice_id % 8 = 6) AS lost FROM purchases
UNION ALL
SELECT 'purchase_price_w_discount', count(*) FILTER (invoice_id % 7 <> 6), count(*) FILTER (invoice_id % 7 IN (0, 4)),
       count(*) FILTER (invoice_id % 7 IN (1, 2, 3, 5)) FROM purchases""")
_reg("publish_diff", """WITH o AS (SELECT * FROM purchases),
n AS (SELECT * REPLACE (CASE WHEN invoice_id % 60 = 1 THEN quantity + 1 ELSE quantity END AS quantity) FROM purchases WHERE invoice_id % 50 <> 0)
SELECT * EXCLUDE (w), cast(sum(w) AS BIGINT) AS change FROM (SELECT *, 1 AS w FROM n UNION ALL SELECT *, -1 FROM o)
GROUP BY ALL HAVING sum(w) <> 0""")
_COLUMNS = ["purchase_date", "invoice_id", "store_location", "disp_category", "revenue_subcategory", "product_name", "vendor_name",
            "quantity", "purchase_price_w_discount", "unit_cost"]
_DIGEST = "count({0}) AS filled, cast(coalesce(sum(cast('0x' || substr(md5({0}), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS digest"
_MARKED = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in _COLUMNS)
_reg("fingerprint_columns", "WITH t AS (SELECT " + ", ".join(f"cast({c} AS VARCHAR) AS {c}" for c in _COLUMNS) + " FROM purchases) "
     + " UNION ALL ".join(f"SELECT {name} AS \"column\", {_DIGEST.format(v)} FROM t" for name, v in
                          [("cast(NULL AS VARCHAR)", f"({_MARKED})"), *((f"'{c}'", c) for c in _COLUMNS)]))
ORACLES["source_first_table"] = "SELECT * FROM benchmark"
_reg("money_labels", """SELECT revenue_subcategory, t AS sales_text, cast(replace(replace(t, '$', ''), ',', '') AS DOUBLE) AS sales
FROM (SELECT revenue_subcategory, '$' || format('{:,.0f}', cast(sum(purchase_price_w_discount) AS DOUBLE)) AS t
      FROM purchases WHERE revenue_subcategory IS NOT NULL GROUP BY 1)""")

# Sources and sinks over the sales tables: the fact's own SQL.
for _name in ("sheet_purchases", "sheet_fallback", "catalog_purchases"):
    _reg(_name, "SELECT * FROM purchases")
ORACLES["sheet_checkins"] = "SELECT * FROM events"
_reg("publish_cycle", """WITH s AS (SELECT 'first' AS step, true AS written, 1 AS version, * FROM purchases
UNION ALL SELECT 'same rows', false, 1, * FROM purchases
UNION ALL SELECT 'changed', true, 2, * REPLACE (CASE WHEN invoice_id % 60 = 1 THEN quantity + 1 ELSE quantity END AS quantity)
FROM purchases WHERE invoice_id % 50 <> 0)
SELECT step, written, version, count(*) AS rows, sum(quantity) AS quantity, cast(sum(purchase_price_w_discount) AS DOUBLE) AS sales
FROM s GROUP BY 1, 2, 3""")
ORACLES["snapshot_reuse"] = """SELECT call, call <> 2 AS built, cast(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders
FROM (SELECT unnest([1, 2, 3]) AS call, o_orderdate FROM orders
      UNION ALL SELECT 3, o_orderdate FROM orders WHERE o_orderkey % 10 = 0) GROUP BY 1, 3"""
ORACLES["location_long_list_kpis"] = ORACLES["location_filter_kpis"]
_reg("period_profit", f"""SELECT 'month' AS grain, year, month AS period, year_month AS label, revenue, cost, profit, profit_margin FROM ({_MONTHLY})
UNION ALL SELECT 'quarter', year, quarter, year_quarter, revenue, cost, profit, profit_margin FROM ({QUARTERLY})""")
_reg("quarter_year_cells", f"""WITH q AS ({QUARTERLY}),
g AS (SELECT * FROM (SELECT DISTINCT quarter FROM q) CROSS JOIN (SELECT DISTINCT year FROM q))
SELECT g.quarter, g.year, coalesce(q.profit_margin, 0.0) AS value FROM g LEFT JOIN q ON q.quarter = g.quarter AND q.year = g.year""")
_reg("quarter_year_map", f"""WITH q AS ({QUARTERLY}),
g AS (SELECT * FROM (SELECT DISTINCT quarter FROM q) CROSS JOIN (SELECT DISTINCT year FROM q))
SELECT g.quarter, string_agg(g.year || '=' || cast(round(coalesce(q.profit, 0.0) * 100) AS BIGINT), ',' ORDER BY g.year) AS cents_by_year
FROM g LEFT JOIN q ON q.quarter = g.quarter AND q.year = g.year GROUP BY 1""")
_reg("penetration_sketch_bounds", f"SELECT year, total_invoices, benefit_invoices, true AS total_within, true AS benefit_within FROM ({PEN})")
_reg("product_sketch_bounds", f"SELECT *, true AS within FROM ({PRODUCT_STATS})")
