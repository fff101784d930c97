"""Helpers the operators of this subpackage share: shipping code, shared files, running totals, link components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelbook.session import configure, new_folder, stage

#: Rows per Arrow batch: whole texts travel in them, so a batch stays at a few MB.
ARROW_ROWS = 500
#: Rows of a slice whose running total one task makes.
SLICE_ROWS = 4_000

#: Links a task contracts in memory.
TASK_LINKS = 1_000_000

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators; sends the package to the executors once per application."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        target = os.path.join(tempfile.mkdtemp(prefix="reelbook-code-"), f"reelbook-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(os.path.join(root, "reelbook")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, root))
        context.addPyFile(target)
        _SHIPPED.add(context.applicationId)
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, with the session prepared."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


# Files in the shared folder, written and read by tasks -----------------------------------------------------------------


def file_system(uri: str):
    """pyarrow file system and path of a folder URI or an absolute path."""
    return pa.fs.FileSystem.from_uri(uri)


def unique_file(folder: str, label: str, ending: str) -> str:
    """A file name no other task attempt uses, so that a lost or repeated attempt harms nothing."""
    return f"{folder}/{label}-{uuid.uuid4().hex}{ending}"


def open_output(uri: str):
    """Stream to a new file, its folder made if need be."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    """Random-access reading of a file."""
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def shared_files(spark: SparkSession, label: str) -> str:
    """A new folder for files, as a URI pyarrow takes."""
    folder = new_folder(spark, label)
    return folder if "://" in folder else os.path.abspath(folder.removeprefix("file:"))


# Arrow batches ----------------------------------------------------------------------------------------------------------


def batches_of(schema: pa.Schema, rows: Iterator[tuple], *, size: int = 4000, weight=None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows, or of about ``most`` bytes by ``weight(row)``."""
    kept: list[tuple] = []
    heavy = 0
    for row in rows:
        kept.append(row)
        heavy += weight(row) if weight else 0
        if len(kept) >= size or heavy >= most:
            yield _batch(schema, kept)
            kept, heavy = [], 0
    if kept:
        yield _batch(schema, kept)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def texts_of(batch: pa.RecordBatch, column: str, *keys: str) -> Iterator[tuple]:
    """(keys..., text) of the rows of a batch, one Python text at a time; a null text is empty."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in (*keys, column)]
    for row in zip(*columns):
        yield (*[v.as_py() for v in row[:-1]], row[-1].as_py() or "")


# Running totals without one task per group ------------------------------------------------------------------------------


def running_total(df: DataFrame, group: list[str], size: str, order: list[str], *, n_rows: int, alias: str = "start") -> DataFrame:
    """Adds the sum of ``size`` over the rows before, within ``group``, in a fixed pseudo-random order.

    ``group`` has no nulls. Groups are cut by a hash of the order columns into slices of about ``SLICE_ROWS`` rows, however
    large a group is; slices are summed in parallel and shifted by the totals of the slices before them.
    """
    slices = max(1, -(-n_rows // SLICE_ROWS))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(slices)).cast("int"))
    totals = cut.groupBy(*group, "_slice").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*group, "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(shift, [*group, "_slice"]).select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(alias))


# Components -------------------------------------------------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the larger (or not larger) neighbours of a node are tied to its least neighbour."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("m"))
    tied = both.join(least, "u")
    if large:
        pairs = tied.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        pairs = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return pairs.where(F.col("a") < F.col("b")).distinct()


def _forest(links: DataFrame) -> DataFrame:
    """Links replaced, in each task, by a star per component that the task's own links form."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def contract(batches):
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one, other = top(a), top(b)
                if one != other:
                    above[max(one, other)] = min(one, other)
        yield from batches_of(out, ((top(x), x) for x in list(above) if top(x) != x))

    return links.mapInArrow(contract, "a bigint, b bigint")


def components(links: DataFrame, label: str) -> DataFrame:
    """Least node each linked node reaches: ``node``, ``component``. ``links`` has columns a, b (any order) and is stored.

    Tasks first contract up to ``TASK_LINKS`` links each to a forest. If that took more than one task, large-star and
    small-star contractions follow until the edges are stars. Each round is written to the shared folder, so a lost executor
    costs one round; nothing is gathered on the driver but two sums per round.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b"))
    tasks = max(1, -(-ordered.count() // TASK_LINKS))
    edges = stage(_forest(ordered.repartition(tasks)), f"{label}-edges")
    seen = None
    while tasks > 1:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        edges = stage(_star(_star(edges, True), False), f"{label}-edges")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
