"""Tables kept in buckets of a key's hash, so that a change rewrites only the buckets it touches.

A snapshot is a list that names, for each bucket, the folder that holds it; the list is written last, so a reader sees a change whole or
not at all. A change writes the touched buckets to a folder of its own and a list that names it for them; all other buckets stay where they
are. Two writers that start from one snapshot cannot both finish, as the second finds its list already there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_LIST = "bucket int, folder string, rows long, properties string, version long"


@dataclass(frozen=True)
class Snapshot:
    """State of a bucketed table; a later change leaves it readable."""

    version: int
    folders: dict[int, str | None]
    rows: dict[int, int]
    properties: dict[str, Any]


@dataclass(frozen=True)
class BucketTable:
    """A table of unique non-null keys under a folder."""

    spark: SparkSession
    root: str
    schema: StructType
    key: str

    def create(self, rows: DataFrame, buckets: int, **properties: Any) -> Snapshot:
        """Write the first snapshot. ``buckets`` is meant to give files of some hundred megabytes; it stays as it is."""
        return self._write(rows, Snapshot(-1, dict.fromkeys(range(buckets)), dict.fromkeys(range(buckets), 0), {}), range(buckets), properties)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last snapshot, or one of a given number. The list has one row per bucket."""
        lists = self.spark.read.schema(_LIST).parquet(f"{self.root}/lists")
        if version is None:
            version = lists.agg(F.max("version")).first()[0]
        found = lists.where(F.col("version") == version).collect()
        if not found:
            raise ValueError(f"no snapshot {version}")
        return Snapshot(version, {r["bucket"]: r["folder"] for r in found}, {r["bucket"]: r["rows"] for r in found}, json.loads(found[0]["properties"]))

    def bucket_of(self, snapshot: Snapshot, key: Column | str | None = None) -> Column:
        """Bucket of a key."""
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(len(snapshot.folders))).cast("int")

    def read(self, snapshot: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all or some buckets; other buckets are not opened."""
        wanted = snapshot.folders if buckets is None else buckets
        paths = [f"{self.root}/data/{snapshot.folders[b]}/bucket={b}" for b in wanted if snapshot.folders[b] is not None]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).select(self.schema.fieldNames())

    def touched(self, snapshot: Snapshot, keys: DataFrame) -> list[int]:
        """Buckets of the keys of a table, as many numbers as there are buckets at most."""
        return sorted(r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket_of(snapshot)).distinct().collect())

    def replace(self, snapshot: Snapshot, rows: DataFrame, buckets: list[int], **properties: Any) -> Snapshot:
        """The snapshot after ``buckets`` hold ``rows``, all of which belong there. Properties not named stay."""
        return self._write(rows, snapshot, buckets, snapshot.properties | properties)

    def _write(self, rows: DataFrame, old: Snapshot, buckets, properties: dict[str, Any]) -> Snapshot:
        folder, wanted = uuid.uuid4().hex, set(buckets)
        folders, counts = old.folders | dict.fromkeys(wanted), old.rows | dict.fromkeys(wanted, 0)
        if wanted:
            placed = rows.select(self.schema.fieldNames()).withColumn("bucket", self.bucket_of(old))
            placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            held = StructType([StructField("bucket", IntegerType()), self.schema[self.key]])
            back = self.spark.read.schema(held).parquet(f"{self.root}/data/{folder}")
            repeated = F.count("*") - F.count_distinct(self.key)
            for bucket, n, again in back.groupBy("bucket").agg(F.count("*"), repeated).collect():
                if again:
                    raise ValueError(f"{self.key} is null or given twice in bucket {bucket}")
                if bucket not in wanted:
                    raise ValueError(f"rows of bucket {bucket}, which is not to be replaced")
                counts[bucket], folders[bucket] = n, folder
        new = Snapshot(old.version + 1, folders, counts, properties)
        listed = [(b, folders[b], counts[b], json.dumps(properties)) for b in sorted(folders)]
        schema = "bucket int, folder string, rows long, properties string"
        self.spark.createDataFrame(listed, schema).coalesce(1).write.parquet(f"{self.root}/lists/version={new.version}")
        return new
