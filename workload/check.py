"""Compare queries with their DuckDB twins: ``python -m workload.check FOLDER [NAME...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from workload import queries  # noqa: F401
from workload.registry import ORACLES, QUERIES


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def connect(folder: str):
    """DuckDB with a view per given table."""
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    """Rows as sorted tuples in column-name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is not None, str(v)) for v in t)
    )


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, folder: str, name: str, con) -> str | None:
    """What differs between a query and its twin, or None."""
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if got[1] else "no rows"
    cursor = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    for column, kind in df.dtypes:
        if _TYPES.get(kind) != kinds[column]:
            return f"type of {column}: {kind} != {kinds[column]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference\n   {a}\n   {b}"
    return None if got[1] else "no rows"


def main() -> None:
    from pyspark.sql import SparkSession

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, name, con)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree; {sum(n in ORACLES for n in names)} with a twin")


if __name__ == "__main__":
    main()
