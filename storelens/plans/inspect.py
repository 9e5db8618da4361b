"""Plan inspection: what Catalyst and AQE chose for a DataFrame."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Physical operator names in the formatted plan, top-down."""
    names = re.findall(r"^\(\d+\) ([A-Za-z]+)", plan_text(df), flags=re.M)
    return names


def has_operator(df: DataFrame, name: str) -> bool:
    return any(n == name for n in operators(df))


def exchanges(df: DataFrame) -> int:
    """Number of shuffle exchanges (broadcasts not counted)."""
    return sum(1 for n in operators(df) if n == "Exchange")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)", plan_text(df))


def assert_jvm_only(df: DataFrame) -> None:
    """No Python UDF, no cartesian product and no nested-loop join anywhere in the plan."""
    ops = set(operators(df))
    bad = {
        o
        for o in ops
        if "Python" in o or "ArrowEval" in o or o in ("CartesianProduct", "BroadcastNestedLoopJoin")
    }
    if bad:
        raise AssertionError(f"plan uses {sorted(bad)}")
