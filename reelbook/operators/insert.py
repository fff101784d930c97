"""New rows for any catalogue table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.operators.changes import next_key
from reelbook.operators.numbering import surrogate_keys
from reelbook.operators.quality import reasons_of, value_checks
from reelbook.schemas import ENTITIES
from reelbook.session import stage


def _default(entity: str, column: str, as_of: Column | date | datetime) -> Column:
    """What a column takes when no value is given: its declared default, or null."""
    if column in C.CLOCK_DEFAULTS.get(entity, {}):
        now = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp_ntz")
        return F.date_trunc("day", now) if C.CLOCK_DEFAULTS[entity][column] == "day" else now
    return F.lit(C.DEFAULTS.get(entity, {}).get(column))


def insert_rows(table: DataFrame, rows: DataFrame, entity: str, *, order: str, as_of: Column | date | datetime) -> tuple[DataFrame, DataFrame]:
    """The table with new rows, and the rows refused: ``order``, reasons.

    ``rows`` has any of the columns of the table but ``pk``; an absent column or a null takes the declared default. ``order`` is
    a further column, unique, that tells which row comes first. A row is refused if a required value is missing, a text too
    long, a choice unknown, or its unique columns are taken by the table or by an earlier row that is itself not refused; nulls
    never clash. New keys follow the highest key in use and depend on the rows alone.
    """
    fields = [f for f in ENTITIES[entity].fields if f.name != "pk"]
    if order in table.columns:
        raise ValueError(f"the column of the order must not be one of the table's: {order}")
    values = [
        (F.coalesce(F.col(f.name), _default(entity, f.name, as_of)) if f.name in rows.columns else _default(entity, f.name, as_of))
        .cast(f.dataType).alias(f.name)
        for f in fields
    ]
    nullable = {fk for fk, _, action in C.FOREIGN_KEYS.get(entity, []) if action != "cascade"}
    optional = nullable | set(C.DEFAULTS.get(entity, {})) | set(C.CLOCK_DEFAULTS.get(entity, {}))
    required = [c for c in C.REQUIRED[entity] if c not in optional]
    checked = rows.select(F.col(order).alias("_order"), *values)
    reasons = reasons_of(value_checks(entity, required))
    checked = checked.withColumn("_reasons", reasons)
    keys = C.UNIQUE.get(entity)
    if keys:
        taken = table.select(*keys).distinct().withColumn("_taken", F.lit(True))
        checked = checked.join(taken, keys, "left")
        free = checked.where((F.size("_reasons") == 0) & F.col("_taken").isNull())
        first = free.groupBy(*keys).agg(F.min("_order").alias("_first"))
        clash = F.coalesce(F.col("_taken"), F.col("_first") < F.col("_order"), F.lit(False))
        reason = F.lit(f"{', '.join(keys)} not unique")
        checked = checked.join(first, keys, "left").withColumn("_reasons", F.when(clash, F.array_append("_reasons", reason)).otherwise(F.col("_reasons")))
    names = [f.name for f in fields]
    checked = stage(checked.select("_order", *names, "_reasons"), "insert")
    added = surrogate_keys(checked.where(F.size("_reasons") == 0).select("_order", *names), keys or ["_order"], next_key(table))
    refused = checked.where(F.size("_reasons") > 0).select(F.col("_order").alias(order), F.col("_reasons").alias("reasons"))
    return table.unionByName(added.select(table.columns)), refused
