"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings every storelens job relies on.  A value the launch
# configuration already holds (spark-submit --conf, spark-defaults) wins;
# only missing ones are filled in.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Static settings for local and test runs (no web UI, no progress bar).
LOCAL_STATIC = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "storelens",
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local/test session. On a cluster, pass ``master=None`` and let
    ``spark-submit`` supply the master and sizing; ``extra`` always applies."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master).config("spark.driver.memory", driver_memory)
    for k, v in LOCAL_STATIC.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    launched = spark.sparkContext.getConf()
    wanted = dict(SESSION_DEFAULTS)
    if master:  # on a cluster the launch (or Spark's own default) sizes the shuffles
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in wanted.items():
        if not launched.contains(k):
            spark.conf.set(k, v)
    for k, v in (extra or {}).items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is ``fallback`` installed
    as the context's checkpoint dir, and a folder of this context's own in it
    returned; it is never a machine-local default on a cluster.
    """
    sc = spark.sparkContext
    d = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if not d:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set and no fallback was given")
        if "://" not in fallback:
            os.makedirs(fallback, exist_ok=True)
        # The setting itself cannot be changed in a running session.
        sc.setCheckpointDir(fallback)
        d = sc.getCheckpointDir()
    return d


FREE_SHUFFLES_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within the block, the shuffle files of a query go when the query ends.
    Otherwise they stay until the driver's garbage collection meets them, and
    a job of several passes holds the shuffles of all of them on disk at once.
    A version of Spark without the setting ignores it."""
    was = spark.conf.get(FREE_SHUFFLES_CONF, None)
    spark.conf.set(FREE_SHUFFLES_CONF, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(FREE_SHUFFLES_CONF)
        else:
            spark.conf.set(FREE_SHUFFLES_CONF, was)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; a local session that names no such
    folder gets a temporary one of its own."""
    master = spark.sparkContext.master
    try:
        base = shared_dir(spark)
    except RuntimeError:
        if not master.startswith("local") or "cluster" in master:
            raise
        base = shared_dir(spark, tempfile.mkdtemp(prefix="storelens-"))
    return f"{base.rstrip('/')}/storelens/{tag}-{uuid.uuid4().hex}"
