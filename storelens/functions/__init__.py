"""Column expressions, fixed values and column-role resolution."""

from . import constants
from .exprs import (
    daypart,
    first_word,
    half_even,
    hour_label,
    is_benefit,
    mean,
    money_sum,
    money_text,
    month_day_key,
    month_label,
    parse_money,
    pct_change,
    percent,
    percent_or_zero,
    quarter_label,
    ratio,
    truncate_label,
    week_ending,
    weekday_label,
    year_month,
    year_quarter,
    ytd_mask,
)
from .roles import ColumnRoles, MissingRole, resolve_roles, roles_of

__all__ = [
    "constants",
    "ColumnRoles",
    "MissingRole",
    "resolve_roles",
    "roles_of",
    "daypart",
    "first_word",
    "half_even",
    "hour_label",
    "is_benefit",
    "mean",
    "money_sum",
    "money_text",
    "month_day_key",
    "month_label",
    "parse_money",
    "pct_change",
    "percent",
    "percent_or_zero",
    "quarter_label",
    "ratio",
    "truncate_label",
    "week_ending",
    "weekday_label",
    "year_month",
    "year_quarter",
    "ytd_mask",
]
