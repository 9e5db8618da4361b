"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AFTERNOON, EVENING, MORNING, NIGHT


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, digits: int) -> Column:
    """Round a double like pandas/NumPy: scale, round half to even, unscale.

    Spark's ``bround`` rounds the decimal text instead, which differs at
    values such as 1.015; ``rint(x * 10^n) / 10^n`` reproduces NumPy exactly.
    """
    scale = float(10**digits)
    return F.rint(col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def as_double(c: str | Column) -> Column:
    return col(c).cast("double")


def money_sum(c: str | Column) -> Column:
    """Sum that is 0 (not null) when the group has no non-null value."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def mean(c: str | Column) -> Column:
    """Mean of the non-null values as a double (null when there are none)."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)).cast("double"))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 or null (ANSI-safe)."""
    return F.try_divide(as_double(num), as_double(den))


def percent(num: str | Column, den: str | Column, digits: int | None = None) -> Column:
    """num / den * 100, optionally rounded half-even; null when den is 0."""
    p = ratio(num, den) * F.lit(100.0)
    return half_even(p, digits) if digits is not None else p


def percent_or_zero(num: str | Column, den: str | Column) -> Column:
    """num / den * 100 when den > 0, else 0 (the reference's guarded rates)."""
    return F.when(as_double(den) > 0, ratio(num, den) * F.lit(100.0)).otherwise(F.lit(0.0))


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """(cur / prev - 1) * 100; null when prev is 0."""
    return (ratio(cur, prev) - F.lit(1.0)) * F.lit(100.0)


def week_ending(c: str | Column) -> Column:
    """Calendar date of the Sunday that ends the row's week (pandas freq='W')."""
    return F.date_add(F.to_date(col(c)), F.lit(6) - F.weekday(col(c)))


def year_month(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def year_quarter(c: str | Column) -> Column:
    return F.format_string("%d Q%d", F.year(col(c)), F.quarter(col(c)))


def month_label(year: str | Column, month: str | Column) -> Column:
    """``2024-03`` from the numbers: cheaper than formatting every row's date."""
    return F.format_string("%04d-%02d", col(year), col(month))


def quarter_label(year: str | Column, quarter: str | Column) -> Column:
    return F.format_string("%d Q%d", col(year), col(quarter))


def weekday_label(day_num: str | Column) -> Column:
    """Name of a weekday number, Monday is 0."""
    names = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
    return F.element_at(F.array(*[F.lit(n) for n in names]), col(day_num) + 1)


def daypart(hour: str | Column) -> Column:
    h = col(hour)
    return (
        F.when((h >= 5) & (h < 12), F.lit(MORNING))
        .when((h >= 12) & (h < 17), F.lit(AFTERNOON))
        .when((h >= 17) & (h < 21), F.lit(EVENING))
        .otherwise(F.lit(NIGHT))
    )


def hour_label(hour: str | Column) -> Column:
    """Two-digit hour text, e.g. ``05:00``."""
    return F.format_string("%02d:00", col(hour))


def money_text(c: str | Column, digits: int) -> Column:
    """``$1,234`` style text (half-even on the double, like Python's format)."""
    return F.concat(F.lit("$"), F.format_number(as_double(c), digits))


def parse_money(c: str | Column) -> Column:
    """Inverse of :func:`money_text`: strip ``$`` and ``,`` and cast."""
    return F.regexp_replace(col(c), r"[$,]", "").try_cast("double")


def is_benefit(c: str | Column, pattern: str) -> Column:
    """Case-insensitive literal substring test; null is not a match."""
    return F.coalesce(F.lower(col(c)).contains(F.lit(pattern.lower())), F.lit(False))


def truncate_label(c: str | Column, width: int = 15) -> Column:
    s = col(c).cast("string")
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)


def first_word(c: str | Column) -> Column:
    return F.split(col(c), " ").getItem(0)


def month_day_key(c: str | Column) -> Column:
    """``month * 100 + day``: orders dates by their place in the calendar year."""
    return F.month(col(c)) * 100 + F.dayofmonth(col(c))


def ytd_mask(date: str | Column, as_of_key: str | Column) -> Column:
    """Same month/day window as the as-of date in every year (leap day safe).

    ``month < M or (month = M and day <= D)`` is ``month*100+day <= M*100+D``
    (days are < 100), so the as-of date is referenced once: one scalar
    subquery, one extra scan, whatever the caller passes.
    """
    return month_day_key(date) <= col(as_of_key)
