"""Sources (star-schema fixture, table readers, cleaning) and sinks."""

from .clean import canonical, clean_columns, coerce_dates, coerce_numbers, preprocess
from .publish import column_digests, fingerprint, latest_version, multiset_equal, publish_if_changed, sample_rows
from .readers import list_tables, read_sales, resolve_source, select_table
from .star import checkins, purchases

__all__ = [
    "canonical",
    "checkins",
    "clean_columns",
    "coerce_dates",
    "coerce_numbers",
    "column_digests",
    "fingerprint",
    "latest_version",
    "list_tables",
    "multiset_equal",
    "preprocess",
    "publish_if_changed",
    "purchases",
    "read_sales",
    "resolve_source",
    "sample_rows",
    "select_table",
]
