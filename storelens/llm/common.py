"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# A side of a join is broadcast only when its counted rows stay under this.
BROADCAST_ROWS = 2_000_000
ARROW_ROWS = 1_000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per context
    (a launch with ``--py-files`` or an installed package works as well), and
    unless the session says otherwise lets Arrow carry ``ARROW_ROWS`` rows at
    a time: rows here are whole documents."""
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_ROWS, "10000") == "10000":
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    if getattr(sc, "_storelens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="storelens-ship-")) / "storelens_llm.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._storelens_shipped = True


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``).

    Only a local session that names none gets a temporary folder of its own.
    """
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    try:
        base = shared_dir(spark)
    except RuntimeError:
        if not local:
            raise
        base = shared_dir(spark, tempfile.mkdtemp(prefix="storelens-llm-"))
    return f"{base.rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends
    there, so a lost executor re-reads files instead of recomputing."""
    path = scratch(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are within ``rows``;
    otherwise unchanged (the planner then shuffles both sides).  Give it thin
    rows from a written table: it is counted by one job."""
    return F.broadcast(df) if df.count() <= rows else df


def text_hash(text) -> Column:
    """A 64-bit hash of the text (null as empty): with doc_id it names a row's
    content, so repeated ids with other texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def text_key(df: DataFrame) -> DataFrame:
    """doc_id, text and their ``_th``."""
    return df.select("doc_id", "text", text_hash("text").alias("_th"))


def whole_rows(df: DataFrame) -> DataFrame:
    """``_row`` (all columns, so that none clashes with an operator's own),
    ``_id`` and ``_th``."""
    return df.select(F.struct("*").alias("_row")).select("_row", F.col("_row.doc_id").alias("_id"), text_hash(F.col("_row.text")).alias("_th"))


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of ``_row`` again, with another text if given."""
    return df.select(*[text.alias(c) if c == "text" and text is not None else F.col(f"_row.`{c}`").alias(c) for c in columns])
