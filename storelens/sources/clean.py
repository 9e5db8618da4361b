"""Cleaning of a raw purchases / check-ins table (PRE-1..5).

One projection: trimmed column names, text date columns parsed to
``timestamp_ntz`` (bad text -> null), text price/amount columns cast to
double (bad text -> null), and NaN in floating columns turned into null
(pandas skips NaN in sums and means; Spark would propagate it).  Everything
is a built-in expression, evaluated on the executors during the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K


def _name_changes(df: DataFrame) -> list[tuple[str, str]]:
    pairs = [(c, c.strip()) for c in df.columns]
    seen: set[str] = set()
    for _, new in pairs:
        if new in seen:
            raise ValueError(f"column names collide after trimming: {new!r}")
        seen.add(new)
    return pairs


def clean_columns(df: DataFrame) -> DataFrame:
    """PRE-2: strip surrounding whitespace from every column name."""
    return df.toDF(*[new for _, new in _name_changes(df)])


def parse_timestamp(c: Column, formats: Sequence[str] = K.DATE_FORMATS) -> Column:
    """Text -> timestamp_ntz using the first format that matches; else null.
    A zone suffix is dropped: the wall-clock time is kept.

    ``try_to_timestamp`` only tests whether a format matches; the value is
    parsed straight to ``timestamp_ntz`` (wall-clock time, like pandas'
    naive datetimes), so neither the session time zone nor a DST gap can
    shift it.
    """
    s = F.regexp_replace(F.trim(c), "^([0-9-/]+)T(?=[0-9])", "$1 ")
    s = F.regexp_replace(s, "(?<=:[0-9]{2}(?:[.][0-9]{1,9})?) ?(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    s = F.replace(s, F.lit("/"), F.lit("-"))
    return F.coalesce(
        *[F.when(F.try_to_timestamp(s, F.lit(f)).isNotNull(), F.to_timestamp_ntz(s, F.lit(f))) for f in formats]
    )


def parse_number(c: Column) -> Column:
    """Text -> double; text that is not a plain number (``$3``, ``1,000``,
    ``nan``, ``Infinity``, ``2d``) -> null."""
    s = F.trim(c)
    return F.when(s.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def _is_date_name(name: str) -> bool:
    return K.DATE_WORD in name.lower()


def _is_number_name(name: str) -> bool:
    return any(w in name.lower() for w in K.NUMBER_WORDS)


def preprocess(df: DataFrame, formats: Sequence[str] = K.DATE_FORMATS) -> DataFrame:
    """PRE-5: the whole cleaner as one ``select``.

    Only text columns are converted (a numeric price or a real timestamp is
    left as it is), as in the reference.
    """
    cols = []
    for old, new in _name_changes(df):
        field = df.schema[old]
        c = F.col(f"`{old}`")
        is_text = isinstance(field.dataType, T.StringType)
        if is_text and _is_date_name(new):
            c = parse_timestamp(c, formats)
        elif is_text and _is_number_name(new):
            c = parse_number(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        cols.append(c.alias(new))
    return df.select(*cols)


def parse_losses(df: DataFrame, formats: Sequence[str] = K.DATE_FORMATS) -> DataFrame:
    """How many non-blank texts each converted column of :func:`preprocess`
    loses: rows of (column, texts, parsed, lost).  One pass over the input."""
    stats = []
    for old, new in _name_changes(df):
        if not isinstance(df.schema[old].dataType, T.StringType):
            continue
        c = F.col(f"`{old}`")
        if _is_date_name(new):
            parsed = parse_timestamp(c, formats)
        elif _is_number_name(new):
            parsed = parse_number(c)
        else:
            continue
        text = F.count(F.when(F.trim(c) != "", F.lit(1)))
        stats.append(F.struct(F.lit(new).alias("column"), text.alias("texts"), F.count(parsed).alias("parsed")))
    if not stats:
        return df.sparkSession.createDataFrame([], "column string, texts bigint, parsed bigint, lost bigint")
    one = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return one.withColumn("lost", F.col("texts") - F.col("parsed"))


def coerce_dates(df: DataFrame, formats: Sequence[str] = K.DATE_FORMATS) -> DataFrame:
    """PRE-3 alone."""
    cols = [
        (parse_timestamp(F.col(f"`{f.name}`"), formats) if isinstance(f.dataType, T.StringType) and _is_date_name(f.name)
         else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def coerce_numbers(df: DataFrame) -> DataFrame:
    """PRE-4 alone."""
    cols = [
        (parse_number(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) and _is_number_name(f.name)
         else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


# Canonical types of the role columns: money exact to the cent.
CANONICAL_TYPES = {
    "price": "decimal(18,2)",
    "cost": "decimal(18,2)",
    "quantity": "double",
    "category": "string",
    "subcategory": "string",
    "product": "string",
    "vendor": "string",
    "location": "string",
}


def canonical(df: DataFrame, money: str = "decimal(18,2)", invoice: str | None = "bigint") -> DataFrame:
    """Cast the role columns to the canonical fact schema, one projection.

    Text that does not parse becomes null (``try_cast``); a date role given
    as text is parsed like :func:`preprocess`.  ``money`` may be ``double``;
    ``invoice=None`` leaves the invoice column's type alone.
    """
    from ..functions.roles import resolve_roles

    r = resolve_roles(df.schema)
    target = {getattr(r, role): t for role, t in CANONICAL_TYPES.items() if getattr(r, role)}
    for role in ("price", "cost"):
        if getattr(r, role):
            target[getattr(r, role)] = money
    if r.invoice and invoice:
        target[r.invoice] = invoice
    date_text = next(
        (f.name for f in df.schema.fields if _is_date_name(f.name) and isinstance(f.dataType, T.StringType)), None
    )
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == date_text and r.date is None:
            c = parse_timestamp(c)
        elif f.name in target and f.dataType.simpleString() != target[f.name]:
            src = F.trim(c) if isinstance(f.dataType, T.StringType) else c
            c = src.try_cast(target[f.name])
        cols.append(c.alias(f.name))
    return df.select(*cols)
