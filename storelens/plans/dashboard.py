"""The dashboard's query lifecycle as lazy DataFrames.

A :class:`FilterState` holds what the reference's sidebar holds: a date
range (or preset), locations, categories and subcategories.  ``apply``
turns it into the filtered view, in the reference's order (date, location,
category, subcategory), with the reference's rules: empty selections do not
filter, subcategories only apply inside a category selection, location
options come from the date-filtered data and category options from all data.
Nothing runs until a section's result is used.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Literal

from pyspark.sql import DataFrame, Row

from ..functions import constants as K
from ..functions.roles import ColumnRoles, resolve_roles
from ..operators import benefits, filters, insights, products, rollups, vendors, yoy
from ..operators import calendar as cal
from ..sources import publish
from ..sources.cache import cached

Preset = Literal["all", "last_30", "last_90"]


@dataclass(frozen=True)
class FilterState:
    start: object | None = None
    end: object | None = None
    preset: Preset = "all"
    end_inclusive: Literal["midnight", "day"] = "midnight"
    # None = the reference's default selection (first five options);
    # an empty tuple = nothing selected (no filter).
    locations: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    subcategories: tuple[str, ...] = field(default_factory=tuple)

    def resolved(self, df: DataFrame, roles: ColumnRoles | None = None) -> "FilterState":
        """The same state with every data-dependent part turned into values,
        as the reference's sidebar shows them: the date bounds (one row) and
        the default selections (at most ``DEFAULT_SELECTION_SIZE`` options
        each).  Bounded driver reads; afterwards every filter is a literal
        that Catalyst pushes into the scan, so each section re-plans nothing."""
        r = roles or resolve_roles(df.schema)
        st = self
        dated = df
        if r.date and st.start is None and st.end is None:
            ext = filters.date_extent(df, r).first()
            if ext is not None and ext["max_day"] is not None:
                hi = ext["max_day"]
                lo = {"all": ext["min_day"], "last_30": hi - _days(30), "last_90": hi - _days(90)}[st.preset]
                st = replace(st, start=lo, end=hi)
            dated = filters.date_range(df, st.start, st.end, end_inclusive=st.end_inclusive, roles=r)
        if r.location and st.locations is None:
            opts = filters.default_selection(dated, "location", roles=r).collect()
            st = replace(st, locations=tuple(o[0] for o in opts))
        if r.category and st.categories is None:
            opts = filters.default_selection(df, "category", roles=r).collect()
            st = replace(st, categories=tuple(o[0] for o in opts))
        return st


def _days(n: int):
    import datetime as _dt

    return _dt.timedelta(days=n)


def apply(df: DataFrame, state: FilterState = FilterState(), roles: ColumnRoles | None = None) -> DataFrame:
    r = roles or resolve_roles(df.schema)
    v = df
    if r.date:
        if state.start is not None or state.end is not None:
            v = filters.date_range(v, state.start, state.end, end_inclusive=state.end_inclusive, roles=r)
        elif state.preset == "last_30":
            v = filters.last_n_days(v, 30, r)
        elif state.preset == "last_90":
            v = filters.last_n_days(v, 90, r)
        else:
            v = filters.all_time(v, r)
    if r.location:
        locs = state.locations if state.locations is not None else filters.default_selection(v, "location", roles=r)
        v = filters.in_locations(v, locs, r)
    if r.category:
        cats = state.categories if state.categories is not None else filters.default_selection(df, "category", roles=r)
        v = filters.in_categories(v, cats, r)
        if r.subcategory and state.subcategories:
            v = filters.in_subcategories(v, state.subcategories, cats, r)
    return v


# Sections the reference shows only when at least two months have revenue and
# two years are present (INS-7): the monthly trend and everything
# year-over-year below it.
YOY_BLOCK = (
    "monthly_profit", "yoy_quarterly", "yoy_quarterly_long", "quarter_year_pivot", "ytd_window", "ytd_metrics", "ytd_changes",
    "profitability_insights", "benefit_ytd", "benefit_changes", "benefit_revenue_share", "benefit_insights", "benefit_monthly",
    "benefit_penetration", "penetration_changes", "penetration_insights", "category_with_benefit",
    "category_benefit_penetration", "category_penetration_change", "category_insights",
)

# The roles each section reads; a section without them is left out (COL-5).
_PL = ("date", "price", "cost")
_BEN = ("date", "price", "cost", "subcategory")
_PEN = ("date", "subcategory", "invoice")
_CAT = ("date", "price", "cost", "category", "subcategory", "invoice")
_PRODUCT = ("subcategory", "product", "quantity", "price", "invoice")
NEEDS: dict[str, tuple[str, ...]] = {
    "kpis": ("price",), "profit_kpis": ("price", "cost"), "scope": ("category",), "preview": (),
    "location_options": ("location",), "category_options": ("category",), "subcategory_options": ("category", "subcategory"),
    "top_locations": ("location", "price"), "weekly_sales": ("date", "price"),
    "weekly_sales_by_location": ("date", "price", "location"), "profit_by_subcategory": ("subcategory", "price", "cost"),
    "subcategory_sales": ("subcategory", "price"), "subcategory_sales_top": ("subcategory", "price"),
    "profit_by_subcategory_top": ("subcategory", "price", "cost"),
    "monthly_profit": _PL, "quarterly_profit": _PL, "yoy_quarterly": _PL, "yoy_quarterly_long": _PL, "quarter_year_pivot": _PL,
    "ytd_window": ("date",), "ytd_metrics": _PL, "ytd_changes": _PL, "profitability_insights": _PL,
    "benefit_ytd": _BEN, "benefit_monthly": ("date", "price", "subcategory"), "benefit_changes": _BEN,
    "benefit_revenue_share": _BEN, "benefit_insights": _BEN,
    "benefit_penetration": _PEN, "penetration_changes": _PEN, "penetration_insights": (*_BEN, "invoice"),
    "category_with_benefit": _CAT, "category_benefit_penetration": _CAT, "category_penetration_change": _CAT,
    "category_insights": _CAT,
    "product_highlights": _PRODUCT, "highlight_leaders": _PRODUCT,
    "vendor_performance": ("vendor", "price"), "vendor_concentration": ("vendor", "price"),
    "vendors_by_sales": ("vendor", "price"), "vendors_by_count": ("vendor", "price"), "vendors_by_average": ("vendor", "price"),
    "vendors_by_profit": ("vendor", "price", "cost"), "vendors_by_margin": ("vendor", "price", "cost"),
    "vendor_scatter": ("vendor", "price"), "vendor_detail": ("vendor", "price"),
    "hourly_sales": ("date", "price"), "daypart_sales": ("date", "price"), "peak_time": ("date", "price"),
    "weekday_sales": ("date", "price"),
}

# Sections as long as an open key (every vendor, every week of every location);
# ``collect_all`` leaves them as DataFrames.
OPEN_ENDED = (
    "vendor_performance", "weekly_sales_by_location", "profit_by_subcategory", "subcategory_sales",
    "location_options", "category_options", "subcategory_options",
)


def wide_pivot(quarters: DataFrame, value: str = "profit") -> DataFrame:
    """PIV-1 with a column for each year present: they are read first, a row
    each, from the kept QTR-1 rows, so the data is scanned once."""
    kept = cached(quarters)
    years = sorted(r[0] for r in kept.select("year").distinct().collect())
    return yoy.pivot_quarters(kept, value, years)


class Dashboard:
    """Every section of the page as a lazy DataFrame over one filter state."""

    def __init__(
        self,
        df: DataFrame,
        state: FilterState = FilterState(),
        pattern: str = K.BENEFIT_PATTERN,
        category: str = K.FOCUS_CATEGORY,
        resolve: bool = True,
        gate_yoy: bool = True,
    ):
        """``resolve=True`` (the default) reads the filter defaults and the
        YTD as-of date once (a few values); ``False`` keeps everything lazy,
        at the price of re-deriving them inside every section's plan."""
        self.original = df
        self.roles = resolve_roles(df.schema)
        self.state = state.resolved(df, self.roles) if resolve else state
        self.df = apply(df, self.state, self.roles)
        self.pattern = pattern
        self.category = category
        self.resolve = resolve
        self.as_of = None
        if resolve and self.roles.date:
            self.as_of = self.df.agg({self.roles.date: "max"}).first()[0]
        self._cube: DataFrame | None = None
        self.gate_yoy = gate_yoy and resolve and all(getattr(self.roles, role) for role in _BEN)
        self._ready: bool | None = None

    def yoy_ready(self) -> bool:
        """INS-7: at least two months with revenue, and two years."""
        if self._ready is None:
            row = cal.yoy_readiness_from_cube(self.cube()).first()
            self._ready = bool(row is not None and row["ready"])
        return self._ready

    def cube(self) -> DataFrame:
        """The calendar cube of the filtered view, cached: a small table
        (one row per day and hour) that the date-keyed sections share, so
        they cost one scan of the fact together.  Cached blocks lost with an
        executor are recomputed from the lineage."""
        if self._cube is None:
            self._cube = cal.calendar_cube(self.df, self.pattern, self.roles).cache()
        return self._cube

    def has(self, name: str) -> bool:
        """COL-5: whether the input has the roles of a section."""
        return all(getattr(self.roles, role) is not None for role in NEEDS[name])

    def sections(self) -> dict[str, DataFrame]:
        """Every section whose roles the input has, by name."""
        d, p, c, a = self.df, self.pattern, self.category, self.as_of
        build = {
            "preview": lambda: publish.sample_rows(d),
            "location_options": lambda: filters.filter_options(d, "location"),
            "category_options": lambda: filters.filter_options(self.original, "category"),
            "subcategory_options": lambda: filters.filter_options(
                self.original, "subcategory", within=list(self.state.categories or ()) or None
            ),
            "top_locations": lambda: rollups.top_locations(d),
            "weekly_sales_by_location": lambda: rollups.weekly_sales(d, by_location=True),
            "profit_by_subcategory": lambda: rollups.profit_by_subcategory(d),
            "profit_by_subcategory_top": lambda: rollups.profit_by_subcategory(d, n=15),
            "scope": lambda: rollups.scope_summary(d, self.original),
            "ytd_window": lambda: filters.ytd_window(d),
            "benefit_penetration": lambda: benefits.benefit_penetration(d, p, a),
            "penetration_changes": lambda: benefits.penetration_changes(d, p, a),
            "category_with_benefit": lambda: benefits.category_with_benefit(d, c, p, a),
            "category_benefit_penetration": lambda: benefits.category_benefit_penetration(d, c, p, a),
            "category_penetration_change": lambda: benefits.category_penetration_change(d, c, p, a),
            "category_insights": lambda: insights.category_insights(d, c, p, a),
            "product_highlights": lambda: products.product_highlights(d, 10, p),
            "highlight_leaders": lambda: products.highlight_leaders(d, 10, p),
            "vendor_performance": lambda: vendors.vendor_performance(d),
            "vendor_concentration": lambda: vendors.vendor_concentration(d),
            "vendors_by_sales": lambda: vendors.top_vendors(d, "total_sales", 15),
            "vendors_by_count": lambda: vendors.top_vendors(d, "transaction_count", 15),
            "vendors_by_profit": lambda: vendors.top_vendors(d, "profit", 15),
            "vendors_by_margin": lambda: vendors.top_vendors(d, "profit_margin", 15, min_txns=10),
            "vendors_by_average": lambda: vendors.top_vendors(d, "avg_transaction", 15, min_txns=5),
            "vendor_scatter": lambda: vendors.top_vendors(d, "total_sales", 20),
            "vendor_detail": lambda: vendors.vendor_detail(d, 30),
            "subcategory_sales": lambda: rollups.subcategory_sales(d),
            "subcategory_sales_top": lambda: rollups.subcategory_sales(d, n=10),
            "kpis": lambda: rollups.sales_kpis(d),
            "profit_kpis": lambda: rollups.profit_kpis(d),
            "weekly_sales": lambda: rollups.weekly_sales(d),
            "monthly_profit": lambda: rollups.monthly_profit(d),
            "quarterly_profit": lambda: rollups.quarterly_profit(d),
            "yoy_quarterly": lambda: yoy.yoy_quarterly(d),
            "yoy_quarterly_long": lambda: yoy.yoy_quarterly_long(d),
            "quarter_year_pivot": lambda: wide_pivot(rollups.quarterly_profit(d)),
            "ytd_metrics": lambda: yoy.ytd_metrics(d, a),
            "ytd_changes": lambda: yoy.ytd_changes(d, a),
            "profitability_insights": lambda: insights.profitability_insights(d, a),
            "benefit_ytd": lambda: benefits.benefit_ytd(d, p, a),
            "benefit_monthly": lambda: benefits.benefit_monthly(d, p),
            "benefit_changes": lambda: benefits.benefit_changes(d, p, a),
            "benefit_revenue_share": lambda: benefits.benefit_revenue_share(d, p, a),
            "benefit_insights": lambda: insights.benefit_insights(d, self.original, p, a, category=c),
            "penetration_insights": lambda: insights.penetration_insights(d, p, a),
            "hourly_sales": lambda: rollups.hourly_sales(d),
            "daypart_sales": lambda: rollups.daypart_sales(d),
            "peak_time": lambda: rollups.peak_time(d),
            "weekday_sales": lambda: rollups.weekday_sales(d),
        }
        if self.resolve and all(getattr(self.roles, role) for role in _BEN):
            build.update(self._date_sections_from_cube())
        out = {name: make() for name, make in build.items() if self.has(name)}
        if self.gate_yoy and not self.yoy_ready():
            for name in YOY_BLOCK:
                if name in out:
                    out[name] = out[name].limit(0)  # hidden section: same schema, no rows
        return out

    def _date_sections_from_cube(self) -> dict:
        q, a = self.cube(), self.as_of
        summary = cal.benefit_year_summary_from_cube(q, a)
        quarters = cal.quarterly_profit_from_cube(q)
        status = lambda: insights.benefit_status(self.df, self.original, self.pattern, self.roles, self.category)
        return {
            "kpis": lambda: cal.sales_kpis_from_cube(q),
            "profit_kpis": lambda: cal.profit_kpis_from_cube(q),
            "weekly_sales": lambda: cal.weekly_sales_from_cube(q),
            "monthly_profit": lambda: cal.monthly_profit_from_cube(q),
            "quarterly_profit": lambda: quarters,
            "yoy_quarterly": lambda: yoy.yoy_quarterly_from(quarters),
            "yoy_quarterly_long": lambda: yoy.yoy_long_from(yoy.yoy_quarterly_from(quarters)),
            "quarter_year_pivot": lambda: wide_pivot(quarters),
            "ytd_metrics": lambda: cal.ytd_metrics_from_cube(q, a),
            "ytd_changes": lambda: cal.ytd_changes_from_cube(q, a),
            "profitability_insights": lambda: insights.profitability_rules(cal.ytd_changes_from_cube(q, a)),
            "benefit_ytd": lambda: benefits.benefit_ytd_from(summary),
            "benefit_monthly": lambda: cal.benefit_monthly_from_cube(q),
            "benefit_changes": lambda: benefits.benefit_changes_from(summary),
            "benefit_revenue_share": lambda: benefits.benefit_revenue_share_from(summary),
            "benefit_insights": lambda: insights.benefit_rules(
                benefits.benefit_changes_from(summary, with_revenue=True)
            ).unionByName(status()),
            "penetration_insights": lambda: insights.penetration_rules(
                benefits.penetration_changes(self.df, self.pattern, a, self.roles),
                benefits.benefit_changes_from(summary).select("value_change").scalar(),
            ),
            "hourly_sales": lambda: cal.hourly_sales_from_cube(q),
            "daypart_sales": lambda: cal.daypart_sales_from_cube(q),
            "peak_time": lambda: cal.peak_time_from_cube(q),
            "weekday_sales": lambda: cal.weekday_sales_from_cube(q),
        }

    def collect_all(self, max_workers: int = 8, names: list[str] | None = None) -> dict[str, list[Row]]:
        """Run the sections concurrently (one Spark job set per thread) and
        return their rows: those bounded by the calendar, a top-n or a rule
        list.  Sections as long as an open key (``OPEN_ENDED``) stay
        DataFrames, read them from ``sections()``."""
        sections = self.sections()
        chosen = [n for n in names or sections if n not in OPEN_ENDED]
        if self._cube is not None:
            self._cube.count()  # build the shared cube once, before the sections race for it
        with ThreadPoolExecutor(max_workers=max_workers) as pool:
            futures = {n: pool.submit(sections[n].collect) for n in chosen}
            return {n: f.result() for n, f in futures.items()}
