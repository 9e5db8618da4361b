"""Column-role resolution over a schema (driver-side metadata only, no job)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import constants as K

_DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


class MissingRole(KeyError):
    """An operator needs a column role the input does not have."""


@dataclass(frozen=True)
class ColumnRoles:
    date: str | None = None
    location: str | None = None
    category: str | None = None
    subcategory: str | None = None
    price: str | None = None
    cost: str | None = None
    quantity: str | None = None
    invoice: str | None = None
    product: str | None = None
    vendor: str | None = None

    def require(self, *names: str) -> "ColumnRoles":
        missing = [n for n in names if getattr(self, n) is None]
        if missing:
            raise MissingRole(f"input lacks column role(s): {', '.join(missing)}")
        return self

    def with_(self, **kw) -> "ColumnRoles":
        return replace(self, **kw)


def _first(fields, pred) -> str | None:
    for f in fields:
        if pred(f):
            return f.name
    return None


def resolve_roles(
    schema: T.StructType | DataFrame,
    location_words: tuple[str, ...] = K.LOCATION_WORDS,
) -> ColumnRoles:
    """Find every role column of a purchases table.

    The date is the first datetime-typed column whose name contains ``date``
    (one rule for filters and charts); the location is the first column whose
    name contains one of ``location_words``; the rest are fixed names.
    """
    if isinstance(schema, DataFrame):
        schema = schema.schema
    fields = list(schema.fields)
    names = {f.name for f in fields}

    def exact(name: str) -> str | None:
        return name if name in names else None

    return ColumnRoles(
        date=_first(fields, lambda f: K.DATE_WORD in f.name.lower() and isinstance(f.dataType, _DATETIME_TYPES)),
        location=_first(fields, lambda f: any(w in f.name.lower() for w in location_words)),
        category=exact(K.CATEGORY),
        subcategory=exact(K.SUBCATEGORY),
        price=exact(K.PRICE),
        cost=exact(K.COST),
        quantity=exact(K.QUANTITY),
        invoice=exact(K.INVOICE),
        product=exact(K.PRODUCT),
        vendor=exact(K.VENDOR),
    )


def roles_of(df: DataFrame, roles: ColumnRoles | None, *required: str) -> ColumnRoles:
    r = roles if roles is not None else resolve_roles(df.schema)
    return r.require(*required)
