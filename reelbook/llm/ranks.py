"""Places of rows in a total order, without sending the table through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbook.session import stage


def ranked(df: DataFrame, order: list[Column], label: str, *, alias: str = "_pos") -> DataFrame:
    """Adds the number of rows before each row, from 0, in ``order``.

    Rows are dealt to ranges of the order and stored with the number of their range; each range is numbered by itself and shifted
    by the rows of the ranges before it. Rows equal in ``order`` lie in one range and are numbered in any order.
    """
    cut = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    shift = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = cut.withColumn("_inside", inside).join(F.broadcast(shift), "_range")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_inside") - 1).cast("bigint").alias(alias))
