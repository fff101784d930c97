"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the plans rely on: measured (run-time) broadcast decisions and skew splitting.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Files are judged by their size in memory when a side is considered for broadcast.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.session.timeZone": "UTC",
}

#: Largest side that is broadcast on purpose, in measured bytes.
BROADCAST_BYTES = 32 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that may have been made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="reelbook-")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only a local session may go without one; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that executors on other machines reach")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


#: Folders handed out, by application, oldest first.
_HANDED_OUT: dict[str, list[str]] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder nobody has used yet, below the shared folder."""
    folder = f"{shared_folder(spark)}/reelbook/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def drop_staged(spark: SparkSession, *, since: int = 0) -> int:
    """Remove the folders this application has been handed out, or those after the first ``since``; how many were there.

    Frames read from them cannot be computed any more, so results are written before.
    """
    mine = _HANDED_OUT.get(spark.sparkContext.applicationId, [])
    dropped, mine[since:] = mine[since:], []
    found = 0
    for folder in dropped:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Folders handed out inside are removed at the end, also after an error. Results leave the block written, not as frames."""
    since = len(_HANDED_OUT.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_staged(spark, since=since)


def stage(df: DataFrame, label: str, *, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder now and return it as read back.

    For results that several later branches need: they are computed once, survive the loss of
    executors, and Spark knows their size when it chooses joins. The folder is the caller's to keep or drop.
    """
    folder = new_folder(df.sparkSession, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(df.columns)


def stage_measured(df: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """Stage a frame and tell whether it is small enough to broadcast, by the bytes its rows hold."""
    staged = stage(df, label)
    row = F.octet_length(F.to_json(F.struct("*"))) + 32
    size = staged.agg(F.coalesce(F.sum(row), F.lit(0)).alias("size")).first()["size"]
    return staged, size <= BROADCAST_BYTES
