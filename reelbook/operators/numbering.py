"""Exact numbering of rows without one task per group.

A plain ``row_number`` sends a whole group, or the whole table, to one task. Here a group is cut
into slices by a value of the row itself, slices are numbered in parallel and shifted by the
number of rows in the slices before them. Nothing depends on how rows happen to be partitioned, so
a retried task gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbook.session import stage


def _shift(slices: DataFrame, group: list[str]) -> DataFrame:
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = slices.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    return counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def number_within(df: DataFrame, group: list[str], order: str, width: float | None = None, *, ties: list[str] = (),
                  alias: str = "position") -> DataFrame:
    """Number the rows of each group from 1 by a column.

    Slices are ranges of (group, value) as Spark measures them, so they hold about equally many rows however the values lie. With
    ``width`` they span that much of a numeric column, which needs no stored copy of the rows.
    """
    if width is None:
        keyed = df.withColumn("_group", F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]))
        placed = sums_before(keyed, ["_group"], [order, *ties], {"_before": F.lit(1)}, "numbered")
        return placed.select(*df.columns, (F.col("_before") + 1).cast("bigint").alias(alias))
    # Structs with equal nulls are equal, so null keys and values are numbered too, and window and join share one partitioning.
    whole = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)])
    cut = df.withColumn("_place", F.struct(whole.alias("group"), F.floor(F.col(order) / F.lit(width)).alias("slice")))
    inside = Window.partitionBy("_place").orderBy(order, *ties)
    before = Window.partitionBy("_place.group").orderBy("_place.slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_place").agg(F.count("*").alias("_n"))
    shift = counts.select("_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(shift, "_place")
        .select(*df.columns, (F.col("_before") + F.col("_rank")).cast("bigint").alias(alias))
    )


def surrogate_keys(df: DataFrame, natural_key: list[str], start: Column, *, digits: int = 3,
                   alias: str = "pk") -> DataFrame:
    """Consecutive keys after ``start``, in the order of the natural key's MD5.

    The leading hex digits cut the table into ``16**digits`` even slices, whatever the keys look
    like; only the slice counts meet in one task. The rows are staged, as they are read twice.
    """
    text = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in natural_key])
    keyed = stage(df.withColumn("_md5", F.md5(text)), "numbered")
    cut = keyed.withColumn("_slice", F.substring("_md5", 1, digits))
    inside = Window.partitionBy("_slice").orderBy("_md5", *natural_key)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(_shift(cut, []), "_slice")
        .select((start + F.col("_before") + F.col("_rank")).cast("bigint").alias(alias), *df.columns)
    )


def paged(df: DataFrame, group: str, pk: str, size: int, *, width: int | None = None) -> DataFrame:
    """Add ``page`` (from 0): rows of a group in pk order, ``size`` to a page."""
    numbered = number_within(df, [group], pk, width, alias="_position")
    page = F.floor((F.col("_position") - 1) / F.lit(size)).cast("bigint")
    return numbered.withColumn("page", page).drop("_position")


def top_rows(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of each group with their ``rank``; map tasks already keep only ``n`` per group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n)


def sums_before(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds, per alias, the sum of a whole-number column over the rows of the group that come before in ``order``.

    Rows are dealt to ranges of (group, order) that Spark measures, so a hot group spreads over as many tasks as it has rows for
    and small groups share one. The ranges are stored with their number; each is summed by itself and shifted by the totals of
    the group's ranges before it, of which there are at most as many as partitions. ``group`` has no nulls; rows equal in
    ``order`` come in any order.
    """
    dealt = df.repartitionByRange(*group, *order).select(*df.columns, *[c.alias(f"_of_{a}") for a, c in sums.items()], F.spark_partition_id().alias("_range"))
    cut = stage(dealt, label)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_range").agg(*[F.sum(f"_of_{a}").alias(f"_in_{a}") for a in sums])
    shift = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_in_{a}").over(before), F.lit(0)).alias(f"_by_{a}") for a in sums])
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.select(*df.columns, "_range", *[F.coalesce(F.sum(f"_of_{a}").over(inside), F.lit(0)).alias(f"_at_{a}") for a in sums])
    return summed.join(shift, [*group, "_range"]).select(*df.columns, *[(F.col(f"_by_{a}") + F.col(f"_at_{a}")).cast("bigint").alias(a) for a in sums])
