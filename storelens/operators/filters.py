"""Row filters and filter-option lists.

Literal bounds become plain comparisons that Catalyst pushes into the
Parquet scan.  Data-dependent bounds (min/max date, as-of date) are
uncorrelated scalar subqueries over a global aggregate: exactly one row,
computed once per query, no join.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import month_day_key, ytd_mask
from ..functions.roles import ColumnRoles, roles_of

# Selections longer than this are joined instead of written into the plan.
LITERAL_VALUES = 10_000
# Joined selections up to this length are broadcast (text of an option or two dozen bytes each).
BROADCAST_VALUES = 1_000_000

_ROLE_ATTR = {"location": "location", "category": "category", "subcategory": "subcategory"}


def _date_type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _ts_literal(df: DataFrame, c: str, value) -> Column:
    """A literal of the date column's own type (keeps the filter pushable)."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast(_date_type(df, c))


def date_extent(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """KPI-4: first and last timestamp, and their calendar days."""
    r = roles_of(df, roles, "date")
    d = F.col(r.date)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date")).select(
        "min_date",
        "max_date",
        F.to_date("min_date").cast("timestamp_ntz").alias("min_day"),
        F.to_date("max_date").cast("timestamp_ntz").alias("max_day"),
    )


def _day_bound(df: DataFrame, c: str, agg) -> Column:
    """Midnight of the first/last day, as a scalar subquery."""
    return df.select(F.to_date(agg(F.col(c))).cast(_date_type(df, c)).alias("b")).scalar()


def date_range(
    df: DataFrame,
    start=None,
    end=None,
    *,
    end_inclusive: str = "midnight",
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """FLT-1: inclusive date range on the date role.

    Bounds are taken at midnight.  With ``end_inclusive="midnight"`` (the
    reference's behaviour) rows after 00:00 on the end day fall out; with
    ``"day"`` the whole end day is kept.  Missing bounds default to the first
    and last day present.  Null dates never pass.
    """
    if end_inclusive not in ("midnight", "day"):
        raise ValueError("end_inclusive must be 'midnight' or 'day'")
    r = roles_of(df, roles, "date")
    d = F.col(r.date)
    # Midnight of the first day is <= every date, so the default start bound
    # only removes nulls and needs no scan.
    first = _ts_literal(df, r.date, start) if start is not None else None
    lo = (d >= first) if first is not None else d.isNotNull()
    hi = _ts_literal(df, r.date, end) if end is not None else _day_bound(df, r.date, F.max)
    rows = _months(df, first, hi)
    if end_inclusive == "day":
        return rows.where(lo & (d < hi + F.expr("INTERVAL 1 DAY")))
    return rows.where(lo & (d <= hi))


def _months(df: DataFrame, lo: Column | None, hi: Column | None) -> DataFrame:
    """Of a fact written by month, only the folders that a date window touches."""
    if K.MONTH not in df.columns:
        return df
    m = F.col(K.MONTH)
    if lo is not None:
        df = df.where(m >= F.trunc(lo.cast("date"), "MM"))
    return df.where(m <= hi.cast("date")) if hi is not None else df


def last_n_days(df: DataFrame, n: int, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-2: the ``n`` days before the last day present (midnight bounds)."""
    r = roles_of(df, roles, "date")
    # One subquery, the lower bound itself: both comparisons keep the plain
    # column on one side, so they reach the scan.
    kind, window = _date_type(df, r.date), F.expr(f"INTERVAL {n} DAYS")
    lo = df.select((F.to_date(F.max(r.date)).cast(kind) - window).cast(kind).alias("b")).scalar()
    d = F.col(r.date)
    return _months(df, lo, lo + window).where((d >= lo) & (d <= lo + window))


def all_time(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-2 "All time": first day to last day, midnight bounds."""
    return date_range(df, roles=roles)


def in_values(df: DataFrame, column: str, values: Iterable | DataFrame | None) -> DataFrame:
    """Membership on the string form of ``column``; empty selection = no filter.

    ``values`` may be a Python list or a one-column DataFrame of selected
    options.  A list of up to ``LITERAL_VALUES`` is an IN list, which reaches
    the scan; a longer one becomes a local table, semi-joined, so the plan
    holds no giant literal, and broadcast if it has at most
    ``BROADCAST_VALUES`` (it is counted here: it came from the driver).  A
    DataFrame is semi-joined without a hint: the planner knows a bounded
    selection's size.
    """
    key = F.col(column).cast("string")
    if values is None:
        return df
    if isinstance(values, DataFrame):
        opt = values.select(values.columns[0]).withColumnRenamed(values.columns[0], "__opt")
        return df.join(opt, key == F.col("__opt"), "left_semi")
    vals = [str(v) for v in values]
    if not vals:
        return df
    if len(vals) <= LITERAL_VALUES:
        return df.where(key.isin(vals))
    distinct = sorted(set(vals))
    side = df.sparkSession.createDataFrame(pa.table({"__opt": pa.array(distinct, pa.string())}))
    side = F.broadcast(side) if len(distinct) <= BROADCAST_VALUES else side
    return df.join(side, key == F.col("__opt"), "left_semi")


def in_locations(df: DataFrame, values, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-3 (cast to string first: fixes numeric location columns)."""
    return in_values(df, roles_of(df, roles, "location").location, values)


def in_categories(df: DataFrame, values, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-4."""
    return in_values(df, roles_of(df, roles, "category").category, values)


def in_subcategories(df: DataFrame, values, categories, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-5: subcategory filter, effective only inside a category selection."""
    if categories is None or (not isinstance(categories, DataFrame) and not list(categories)):
        return df
    return in_values(df, roles_of(df, roles, "subcategory").subcategory, values)


def filter_options(
    df: DataFrame,
    role: str,
    within: Sequence[str] | DataFrame | None = None,
    roles: ColumnRoles | None = None,
) -> DataFrame:
    """FLT-6: sorted distinct non-null string values of a role column.

    ``within`` restricts subcategory options to the chosen categories.
    """
    r = roles_of(df, roles, _ROLE_ATTR[role])
    c = getattr(r, _ROLE_ATTR[role])
    src = df
    if within is not None:
        src = in_categories(df, within, r)
    return (
        src.select(F.col(c).cast("string").alias("option"))
        .where(F.col("option").isNotNull())
        .distinct()
        .orderBy("option")
    )


def default_selection(
    df: DataFrame, role: str, n: int = K.DEFAULT_SELECTION_SIZE, roles: ColumnRoles | None = None
) -> DataFrame:
    """FLT-7: the first ``n`` options (all when there are at most ``n``)."""
    return filter_options(df, role, roles=roles).limit(n)


def as_of_date(df: DataFrame, roles: ColumnRoles | None = None) -> Column:
    """Latest timestamp of ``df`` as a scalar subquery (the YTD as-of date)."""
    r = roles_of(df, roles, "date")
    return df.select(F.max(r.date).alias("as_of")).scalar()


def as_of_key(df: DataFrame, as_of=None, roles: ColumnRoles | None = None) -> Column:
    """The as-of date's ``month*100+day`` key (see :func:`ytd_mask`).

    None: one scalar subquery over ``df``'s latest date; a date, datetime or
    text: a literal; a Column: that column's key.  Use the result once.
    """
    r = roles_of(df, roles, "date")
    if as_of is None:
        return df.select(month_day_key(F.max(r.date))).scalar()
    a = as_of if isinstance(as_of, Column) else _ts_literal(df, r.date, as_of)
    return month_day_key(a)


def year_to_date(df: DataFrame, as_of=None, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-8: same month/day window as ``as_of`` (default: latest date) in every year."""
    r = roles_of(df, roles, "date")
    key = as_of_key(df, as_of, r)
    rows = df.where(F.month(K.MONTH) * 100 <= key) if K.MONTH in df.columns else df
    return rows.where(ytd_mask(r.date, key))


def ytd_window(df: DataFrame, roles: ColumnRoles | None = None) -> DataFrame:
    """FLT-8 / PRJ-25: the as-of date of the YTD comparison, its calendar day
    and its ``'%B %d'`` label (e.g. ``August 01``); one row."""
    r = roles_of(df, roles, "date")
    return df.agg(F.max(r.date).alias("as_of")).select(
        "as_of",
        F.to_date("as_of").cast("timestamp_ntz").alias("as_of_day"),
        F.date_format("as_of", "MMMM dd").alias("as_of_label"),
        month_day_key("as_of").alias("month_day"),
    )
