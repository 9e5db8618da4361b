"""SRC-5: keep a loaded table for repeated queries.

``cached`` persists in executor memory, spilling to executor disk; a lost
executor only drops cached blocks, which Spark recomputes from the lineage.
``snapshot`` keeps a derived table in the shared folder, under the identity of
the files it was derived from: a later call, also of another session, reads
the written table as long as no input file changed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .readers import _FS

#: Input files up to this number are listed by the driver; beyond it a Spark job lists them.
LISTED_FILES = 200


def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist ``df`` (lazily: blocks are stored by the first action)."""
    return df.persist(level)


def release(df: DataFrame) -> DataFrame:
    return df.unpersist(blocking=False)


@dataclass(frozen=True)
class Inputs:
    """Identity of a set of input files (path, length, modification time) and their bytes."""

    key: str
    bytes: int


def inputs(spark: SparkSession, paths: Sequence[str]) -> Inputs:
    """The files under ``paths`` as they are now.  Few files are listed on the
    driver, many by the ``binaryFile`` source on the executors (no contents
    are read) and reduced to one row there."""
    places = [_FS(spark, p) for p in paths]
    if sum(p.count_files() for p in places) <= LISTED_FILES:
        files = sorted(f for p in places for f in p.files())
        found, size = hashlib.sha256(repr(files).encode()).hexdigest(), sum(f[1] for f in files)
    else:
        listed = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
        row = listed.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("newest"),
            F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("digest"),
        ).first()
        found, size = str(tuple(row)), int(row["bytes"] or 0)
    return Inputs(hashlib.sha256(f"{list(paths)}|{found}".encode()).hexdigest()[:20], size)


@dataclass(frozen=True)
class Snapshot:
    """A derived table read from ``path``; ``built``: this call wrote it."""

    df: DataFrame
    path: str
    built: bool


# Opened snapshots by folder (checked against the calling session).  A folder
# lies under the identity of its inputs, so it never describes other ones.
_OPENED: dict[str, DataFrame] = {}


def _complete(spark: SparkSession, base: str) -> str | None:
    """The first finished folder under ``base``; all of them hold the same rows."""
    fs = _FS(spark, base)
    if not fs.exists():
        return None
    done = [path for name, path, is_dir in fs.children() if is_dir and name.startswith("data-") and _FS(spark, f"{path}/_SUCCESS").exists()]
    return min(done, default=None)


def snapshot(spark: SparkSession, name: str, identity: str, write: Callable[[str], None]) -> Snapshot:
    """The table that ``write(path)`` makes of inputs with this identity,
    written once.  Each build writes a folder of its own and only finished
    ones are read, so a lost job leaves nothing behind that could be taken for
    the table, and two sessions that build at once do not disturb each other."""
    base = f"{shared_dir(spark).rstrip('/')}/storelens/{name}/{identity}"
    target = _complete(spark, base)
    built = target is None
    if target is None:
        target = f"{base}/data-{uuid.uuid4().hex}"
        write(target)
    df = _OPENED.get(target)
    if df is None or df.sparkSession is not spark:
        df = _OPENED[target] = spark.read.parquet(target)
    return Snapshot(df, target, built)
