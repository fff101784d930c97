"""Folder listings: recordings and camera parts. File contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbook import constants as C

_SUFFIX = "(" + "|".join(s.replace(".", r"\.") for s in C.VIDEO_SUFFIXES) + ")$"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder (not of its sub-folders): dir, name, path, length, modificationTime."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    return found.select(
        F.regexp_extract("path", r"^(.*/)[^/]*$", 1).alias("dir"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path", "length", "modificationTime",
    )


def inventory_changes(listed: DataFrame, known: DataFrame) -> DataFrame:
    """What an inventory (dir, name, length, modificationTime) has that an earlier one has not: dir, name, length, modificationTime, status.

    ``status`` is ``new``, ``changed`` (another length or time) or ``gone``; a file that is gone has no length and time. Inventories hold a
    file once and may come from a store's own reports, so that no folder has to be listed from one place.
    """
    keys = ["dir", "name"]
    before = known.select(*keys, F.col("length").alias("_length"), F.col("modificationTime").alias("_time"), F.lit(True).alias("_known"))
    both = listed.select(*keys, "length", "modificationTime", F.lit(True).alias("_listed")).join(before, keys, "full_outer")
    moved = ~F.col("length").eqNullSafe(F.col("_length")) | ~F.col("modificationTime").eqNullSafe(F.col("_time"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_listed").isNull(), "gone").when(moved, "changed")
    return both.select(*keys, "length", "modificationTime", status.alias("status")).where(F.col("status").isNotNull())


def list_video_files(files: DataFrame) -> DataFrame:
    """Files whose suffix marks a recording; the set of suffixes is case-sensitive.

    A name that is nothing but a suffix (``.mp4``) has no suffix of its own and is left out.
    """
    return files.where(F.col("name").rlike("[^/]" + _SUFFIX))


def camera_parts(files: DataFrame) -> DataFrame:
    """Camera-part files with their recording ``key`` and ``part`` number."""
    parts = files.select(
        "*",
        F.regexp_extract("name", C.PART_PATTERN, 1).alias("_part"),
        F.regexp_extract("name", C.PART_PATTERN, 2).alias("_key"),
    ).where(F.col("_key") != "")
    return parts.select(
        *files.columns,
        F.col("_key").cast("bigint").alias("key"),
        F.col("_part").cast("bigint").alias("part"),
    )
