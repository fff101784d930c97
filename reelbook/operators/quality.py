"""Validation reports: one row per table row with the list of reasons against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook import constants as C


def reasons_of(checks: dict[str, Column]) -> Column:
    """Names of the checks that hit; an unknown outcome is no hit."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]))


def validate_crop(recordings: DataFrame) -> DataFrame:
    """Recordings whose crop values are out of range: pk, reasons."""
    checks = {
        c: ~F.col(c).between(0.0, 1.0) for c in ("time_code", "miniature_x_offset", "miniature_y_offset")
    } | {"miniature_zoom": ~F.col("miniature_zoom").between(C.ZOOM_MIN, C.ZOOM_MAX)}
    return recordings.select("pk", reasons_of(checks).alias("reasons")).where(F.size("reasons") > 0)


def value_checks(entity: str, required: list[str]) -> dict[str, Column]:
    """Checks of single rows: missing, overlong or unknown values."""
    missing = {f"{c} required": F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required}
    lengths = {f"{c} too long": F.length(c) > n for c, n in C.MAX_LENGTHS[entity].items()}
    choices = {"type_cut unknown": ~F.col("type_cut").isin(C.CUT_TYPES)} if entity == "cuts" else {}
    return missing | lengths | choices


def validate_entity(table: DataFrame, entity: str) -> DataFrame:
    """Rows of a table with missing, overlong or unknown values: entity, pk, reasons."""
    reasons = reasons_of(value_checks(entity, C.REQUIRED[entity]))
    return table.select(F.lit(entity).alias("entity"), "pk", reasons.alias("reasons")).where(F.size("reasons") > 0)


def validate_entities(tables: dict[str, DataFrame]) -> DataFrame:
    """Report over all tables."""
    return reduce(DataFrame.unionByName, [validate_entity(t, e) for e, t in tables.items()])


def orphan_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Foreign keys that point to no row: entity, field, pk, missing_key.

    All foreign keys of all tables, as rows of (table, key), meet all keys in one join.
    """
    held, targets = [], {}
    for entity, keys in C.FOREIGN_KEYS.items():
        entries = F.array(*[F.struct(F.lit(fk).alias("field"), F.lit(target).alias("_target"), F.col(fk).cast("bigint").alias("missing_key")) for fk, target, _ in keys])
        held.append(tables[entity].select(F.lit(entity).alias("entity"), "pk", F.explode(entries).alias("_e")).select("entity", "pk", "_e.*"))
        targets |= {target: tables[target] for _, target, _ in keys}
    known = [t.select(F.lit(name).alias("_target"), F.col("pk").alias("missing_key")) for name, t in targets.items()]
    pointing = reduce(DataFrame.unionByName, held).where(F.col("missing_key").isNotNull())
    left = pointing.join(reduce(DataFrame.unionByName, known), ["_target", "missing_key"], "left_anti")
    return left.select("entity", "field", "pk", "missing_key")
