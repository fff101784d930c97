"""What the operators on embeddings share: usable vectors, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``vector`` (doubles), ``dim`` of the vectors that are not null and have finite components only.

    A key is one vector: of rows that repeat a key the least vector counts. Rows without key take no part.
    """
    doubles = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(F.col(key).cast("bigint").alias("key"), doubles.alias("vector")).where(
        F.col("key").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite)
    )
    return kept.groupBy("key").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
