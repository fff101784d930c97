"""Catalogue tables as versioned Parquet snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelbook.schemas import ENTITIES

#: Tables laid out by a column that the per-tournament reads filter on.
PARTITION_COLUMNS = {"video_metadata": "tournament", "games": "tournament"}


def scan_entity(spark: SparkSession, snapshot: str, name: str) -> DataFrame:
    """Full scan of one table of a snapshot, in declared column order."""
    schema = ENTITIES[name]
    return spark.read.schema(schema).parquet(f"{snapshot}/{name}").select(schema.fieldNames())


def scan_entities(spark: SparkSession, snapshot: str) -> dict[str, DataFrame]:
    """All eight tables of a snapshot."""
    return {name: scan_entity(spark, snapshot, name) for name in ENTITIES}


def write_entity(table: DataFrame, snapshot: str, name: str) -> None:
    """Write one table into a snapshot folder that is not being read.

    A range split on (partition column, pk) cuts a tournament of any size into even files.
    """
    table = table.select(ENTITIES[name].fieldNames())
    column = PARTITION_COLUMNS.get(name)
    if column:
        table.repartitionByRange(column, "pk").write.partitionBy(column).parquet(f"{snapshot}/{name}")
    else:
        table.write.parquet(f"{snapshot}/{name}")


def write_entities(tables: dict[str, DataFrame], snapshot: str) -> None:
    """Write a set of tables as one new snapshot; fails if the folder already holds one."""
    for name, table in tables.items():
        write_entity(table, snapshot, name)
