"""Locating and reading the sales tables (SRC-1..6).

A *source* is a directory (local, HDFS or an object store) that holds named
tables, one per sub-directory or per ``<name>.<format>`` file, i.e. the
workbook's sheets exported to Parquet or CSV.  File-system access goes
through Hadoop's FileSystem API of the session, so every URI Spark can read
works; only listings run on the driver, the data is read by the executors.
``catalog:<database>`` names a database of the session's catalog instead.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import constants as K

log = logging.getLogger(__name__)

# A source that starts so is a database of the session's catalog.
CATALOG = "catalog:"
# Names that Spark gives to the files of one table, and to its partition folders.
_PART_FILE = re.compile(r"^part-\d{5}-[0-9a-f]{8}-")
_PARTITION = re.compile(r"^[^=]+=.*$")


@dataclass(frozen=True)
class TableRef:
    name: str
    path: str


class _FS:
    """Thin access to the session's Hadoop FileSystem for one path."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self._jvm = sc._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(sc._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return bool(self.fs.exists(self.path))

    def is_dir(self) -> bool:
        return bool(self.fs.getFileStatus(self.path).isDirectory())

    def count_files(self) -> int:
        """Files at or under the path (0 if there is none)."""
        return int(self.fs.getContentSummary(self.path).getFileCount()) if self.exists() else 0

    def bytes(self) -> int:
        """Length of the files at or under the path (0 if there is none)."""
        return int(self.fs.getContentSummary(self.path).getLength()) if self.exists() else 0

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def files(self) -> list[tuple[str, int, int]]:
        """(path, length, modification time) of the files at or under the path."""
        if not self.exists():
            return []
        out, it = [], self.fs.listFiles(self.path, True)
        while it.hasNext():
            st = it.next()
            out.append((st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())))
        return out

    def children(self) -> list[tuple[str, str, bool]]:
        out = []
        for st in self.fs.listStatus(self.path):
            p = st.getPath()
            out.append((p.getName(), p.toString(), bool(st.isDirectory())))
        return sorted(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    if path.startswith(CATALOG):
        return bool(spark.catalog.databaseExists(path[len(CATALOG) :]))
    return _FS(spark, path).exists()


def _is_single_table(children: list[tuple[str, str, bool]]) -> bool:
    """Whether a folder is itself one table: every data child is a file or a
    partition folder as Spark names them, and none is named like a sheet."""
    if any(name == "_delta_log" and is_dir for name, _, is_dir in children):
        return True
    data = [(name, is_dir) for name, _, is_dir in children if not name.startswith((".", "_"))]
    sheet = any(w in name.lower() for name, _ in data for w in (K.PURCHASES_NEEDLE, K.CHECKINS_NEEDLE))
    return bool(data) and not sheet and all((_PARTITION if is_dir else _PART_FILE).match(name) for name, is_dir in data)


def list_tables(spark: SparkSession, source: str, fmt: str = "parquet") -> list[TableRef]:
    """Tables of a source directory, or of a catalog database named as
    ``catalog:<database>``, in name order.  A directory that is itself one
    table (Spark output with part files) yields one entry."""
    if source.startswith(CATALOG):
        database = source[len(CATALOG) :]
        if not spark.catalog.databaseExists(database):
            raise FileNotFoundError(f"data source not found: {source}")
        names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
        return [TableRef(name, f"{CATALOG}{database}.`{name}`") for name in names]
    fs = _FS(spark, source)
    if not fs.exists():
        raise FileNotFoundError(f"data source not found: {source}")
    base = source.rstrip("/").rsplit("/", 1)[-1]
    if not fs.is_dir():
        return [TableRef(_strip_ext(base, fmt), source)]
    kids = fs.children()
    if _is_single_table(kids):
        return [TableRef(base, source)]
    refs = []
    for name, path, is_dir in kids:
        if name.startswith((".", "_")):
            continue
        if is_dir or name.lower().endswith(f".{fmt}"):
            refs.append(TableRef(_strip_ext(name, fmt), path))
    return refs


def _strip_ext(name: str, fmt: str) -> str:
    return name[: -(len(fmt) + 1)] if name.lower().endswith(f".{fmt}") else name


def select_table(names: Sequence[str], needle: str) -> str | None:
    """SRC-2: the first name (in source order) containing ``needle``, case-insensitive."""
    for n in names:
        if needle in n.lower():
            return n
    return None


def empty_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def _reader(spark: SparkSession, fmt: str, options: dict | None):
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r


def _load(spark: SparkSession, ref: TableRef, fmt: str, options: dict | None) -> DataFrame:
    if ref.path.startswith(CATALOG):
        return spark.table(ref.path[len(CATALOG) :])
    return _reader(spark, fmt, options).load(ref.path)


def resolve_source(spark: SparkSession, candidates: str | Sequence[str]) -> str:
    """SRC-1: the first candidate that exists (explicit URL/path first, then
    the default master location, then the synced copy)."""
    cands = [candidates] if isinstance(candidates, str) else [c for c in candidates if c]
    for c in cands:
        if path_exists(spark, c):
            return c
    raise FileNotFoundError(f"data file not found; looked for: {', '.join(cands)}")


@dataclass(frozen=True)
class SalesSource:
    """What :func:`read_source` read: the frames, the tables they come from
    (``checkins_table`` is None for the empty frame) and, if the chosen tables
    could not be read, why the first table was taken instead."""

    purchases: DataFrame
    checkins: DataFrame
    purchases_table: str
    checkins_table: str | None
    fallback_reason: str | None = None


def read_source(
    spark: SparkSession,
    candidates: str | Sequence[str],
    fmt: str = "parquet",
    options: dict | None = None,
) -> SalesSource:
    """SRC-1..6: purchases and check-ins from the first existing source.

    purchases = first table whose name contains 'purchase', else the first
    table; checkins = first table containing 'checkin', else an empty frame.
    One row of each is read to see that it can be; if not, the first table is
    used for purchases and check-ins are empty.  The frames are lazy.
    """
    source = resolve_source(spark, candidates)
    tables = list_tables(spark, source, fmt)
    if not tables:
        raise FileNotFoundError(f"no {fmt} tables in {source}")
    by_name = {t.name: t for t in tables}
    names = [t.name for t in tables]
    p_name = select_table(names, K.PURCHASES_NEEDLE) or names[0]
    c_name = select_table(names, K.CHECKINS_NEEDLE)
    try:
        purchases = _load(spark, by_name[p_name], fmt, options)
        checkins = _load(spark, by_name[c_name], fmt, options) if c_name else empty_frame(spark)
        purchases.head()
        if c_name:
            checkins.head()
        return SalesSource(purchases, checkins, p_name, c_name)
    except Exception as e:  # noqa: BLE001 - any read failure takes the fallback path
        log.warning("reading %s failed (%s); falling back to the first table", source, e)
        return SalesSource(_load(spark, tables[0], fmt, options), empty_frame(spark), names[0], None, str(e))


def read_sales(
    spark: SparkSession,
    candidates: str | Sequence[str],
    fmt: str = "parquet",
    options: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(purchases, checkins)`` of :func:`read_source`."""
    s = read_source(spark, candidates, fmt, options)
    return s.purchases, s.checkins
