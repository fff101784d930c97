"""Shards as runs of a Hilbert curve through several metadata dimensions, written whole. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelbook.llm.common import free_name, prepare
from reelbook.session import new_folder, stage

#: Bits per dimension; a dimension is cut at ``2**BITS - 1`` quantiles.
BITS = 5
#: Relative error of the quantiles is one in this number.
QUANTILE_ACCURACY = 2_000
#: Rows or bytes of text that fill a sorted run, which one task sorts and numbers; runs at most, which grow beyond.
RUN_ROWS, RUN_BYTES, MOST_RUNS = 100_000, 64 << 20, 1 << 16
#: Bits of a place on the curve by which runs are cut; cells at most are two to this power.
CURVE_BITS = 20


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Hilbert curve as a machine: for (state, cell bits) the position among the cells and the next state.

    A state is where the curve enters a cube and along which axis it leaves. The tables follow from the Gray code: cell ``w``
    of a cube is entered at ``gray(2 * floor((w - 1) / 2))`` and runs along the axis given by the trailing ones of ``w``.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & mask

    def place(gray: int) -> int:
        w = 0
        while gray:
            w, gray = w ^ gray, gray >> 1
        return w

    def ones(w: int) -> int:
        return (w ^ (w + 1)).bit_length() - 1

    positions, following = [], []
    for state in range(size * dims):
        entry, axis = divmod(state, dims)
        for cell in range(size):
            w = place(turn(cell ^ entry, axis + 1))
            start = 0 if w == 0 else (lambda v: v ^ (v >> 1))(2 * ((w - 1) // 2))
            along = 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % dims
            positions.append(w)
            following.append((entry ^ turn(start, dims - axis - 1)) * dims + (axis + along + 1) % dims)
    return positions, following


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place on the curve of a cell given by one integer of ``bits`` bits per dimension."""
    dims = len(cells)
    positions, following = curve_tables(dims)
    width = 1 << dims
    words = F.array(*[
        sum((F.getbit(c, F.lit(b)).cast("int") * F.lit(1 << d) for d, c in enumerate(cells)), F.lit(0)) for b in range(bits - 1, -1, -1)
    ])
    at = lambda table, i: F.element_at(F.array(*map(F.lit, table)), (i + 1).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))

    def step(so_far: Column, word: Column) -> Column:
        i = so_far["state"] * F.lit(width) + word
        return F.struct((so_far["index"] * F.lit(width) + at(positions, i)).cast("bigint").alias("index"), at(following, i).cast("int").alias("state"))

    return F.aggregate(words, start, step, lambda end: end["index"])


def _string_bounds(rows: DataFrame, column: str, cells: int) -> list[str]:
    """``cells - 1`` values at most, such that the number of those not above a value is its cell, from 1; cells hold about equally many rows.

    Distinct values are counted, sorted in runs and placed by the rows before them, so bounds are exact quantiles in the order of
    the whole UTF-8 bytes, whatever prefix the values share. A value with the rows of several cells has the first of them to itself, and
    the others stay empty, so few values spread over all cells.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    counts = stage(counts, "values")
    n_values, n_rows = counts.agg(F.count("*"), F.sum("n")).first()
    parts = min(max(1, -(-n_values // RUN_ROWS)), MOST_RUNS)
    runs = stage(counts.repartitionByRange(parts, "value").select("value", "n", F.spark_partition_id().alias("run")), "values")
    ahead = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = runs.groupBy("run").agg(F.sum("n").alias("n")).select("run", ahead(Window.orderBy("run")).alias("before"))
    placed = runs.withColumn("inside", ahead(Window.partitionBy("run").orderBy("value"))).join(totals, "run")
    cell = F.expr(f"(before + inside) * {cells - 1}L div {max(n_rows or 0, 1)}L + 1").alias("cell")
    bounds: list[str] = []
    for r in sorted(placed.groupBy(cell).agg(F.min("value").alias("value")).collect()):
        bounds += [r["value"]] * (r["cell"] - len(bounds))
    return bounds


def _bounds_below(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= value))


def hilbert_place(rows: DataFrame, dimensions: list[str], *, bits: int = BITS) -> Column:
    """Place on a Hilbert curve through ``dimensions``, a column of any frame that has them; ``rows`` sets the cells.

    Each dimension is cut at its own quantiles, so cells hold about equally many rows of each; a null lies before all values. One
    aggregation over all rows finds those of numbers, one per column those of strings, which keep the order of their whole bytes.
    The driver gets ``2**bits - 1`` values per dimension.
    """
    kinds = dict(rows.dtypes)
    numbers = [c for c in dimensions if kinds[c] != "string"]
    levels = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = [F.percentile_approx(F.col(c).cast("double"), levels, QUANTILE_ACCURACY) for c in numbers]
    found = dict(zip(numbers, rows.agg(F.count("*"), *cuts).first()[1:]))
    cells = []
    for c in dimensions:
        value = F.col(c) if kinds[c] == "string" else F.col(c).cast("double")
        ends = _string_bounds(rows, c, 1 << bits) if kinds[c] == "string" else sorted(map(float, found[c] or []))
        below = _bounds_below(F.array(*map(F.lit, ends)), value) if ends else F.lit(0)
        cells.append(F.when(value.isNull(), F.lit(0)).otherwise(below).cast("bigint"))
    return curve_index(cells, bits)


def hilbert_order(rows: DataFrame, dimensions: list[str], *, bits: int = BITS, index: str = "curve") -> DataFrame:
    """``rows`` with their place on the curve as :func:`hilbert_place` finds it."""
    return rows.withColumn(index, hilbert_place(rows, dimensions, bits=bits))


def runs_of_weight(cells: DataFrame, runs: int) -> DataFrame:
    """Where each cell of the curve lies in the cumulated weight, counted in runs: _curve, _from, _width.

    ``cells`` has ``_curve`` and ``_weight``, a row for each of at most ``2**CURVE_BITS`` cells.
    """
    total = F.lit(float(max(cells.agg(F.sum("_weight")).first()[0] or 0, 1)))
    before = F.coalesce(F.sum("_weight").over(Window.orderBy("_curve").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.select("_curve", (before * runs / total).alias("_from"), (F.col("_weight") * runs / total).alias("_width"))


def shard_runs(ordered: DataFrame, metadata: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Rows cut into ``shards`` runs of the order whose row counts are at most one apart: adds shard, slot (from 0).

    ``ordered`` has ``_curve``, which leads ``order``, and ``_mix``, a hash from 0 up to 2**53 which follows; ``metadata`` has ``_curve``
    and ``_size`` of every row. A run ends where about ``RUN_BYTES`` of text or ``RUN_ROWS`` rows are reached: the weight of the cells
    before and the hash within the cell tell the run of a row, so no sample of rows is drawn and a cell of any weight is spread
    over as many runs as it fills. Rows with the same keys share a run. Whole rows are shuffled once, sorted and written with their place in
    their run, which the counts of the runs before shift; equal rows may change places, which leaves the result as it is.
    """
    weight = F.col("_size") + F.lit(RUN_BYTES // RUN_ROWS)
    cells = stage(metadata.groupBy("_curve").agg(F.sum(weight).alias("_weight"), F.count("*").alias("_n")), "cells")
    n_rows, total = cells.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    parts = min(max(1, -(-total // RUN_BYTES)), MOST_RUNS)
    placed = ordered.join(stage(runs_of_weight(cells, parts), "cells"), "_curve")  # broadcast by its known size
    run = F.least(F.floor(F.col("_from") + F.col("_width") * (F.col("_mix") / F.lit(float(1 << 53)))), F.lit(parts - 1)).cast("int")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rows before in the partition
    dealt = placed.select(*ordered.columns, run.alias("_run")).repartitionById(parts, F.col("_run")).sortWithinPartitions(*order)
    runs = _stored(dealt.select("*", inside.alias("_inside")), new_folder(ordered.sparkSession, "runs"))
    counts = runs.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The first rank of shard k is the least r with r * shards >= k * n.
    numbered = runs.join(F.broadcast(shift), "_run").withColumn("_rank", (F.col("_before") + F.col("_inside")).cast("bigint"))  # MOST_RUNS rows at most
    placed = numbered.withColumn("_shard", F.expr(f"_rank * {shards}L div {max(n_rows, 1)}L"))
    first = F.expr(f"(_shard * {max(n_rows, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(*ordered.columns, F.col("_shard").cast("int").alias("_shard"), (F.col("_rank") - first).cast("bigint").alias("_slot"))


def _stored(df: DataFrame, folder: str, **by) -> DataFrame:
    """A frame of whole rows written to a folder and read back."""
    df.write.parquet(folder, compression="zstd", **by)
    return df.sparkSession.read.schema(df.schema).parquet(folder).select(df.columns)


def write_shards(docs: DataFrame, shards: int, folder: str, *, text: str = "text", dimensions: tuple[str, ...] = ("lang", "source"),
                 order: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Write ``docs``, whole, as ``shards`` runs of a Hilbert curve; the rows read back and the ranges of each shard.

    Dimensions of the curve are ``dimensions`` and the bytes of the text, so files cut along it can be skipped by language,
    source or size alike. ``folder/rows`` is Parquet partitioned by shard, with all columns, ``slot`` and ``curve_index``;
    ``folder/ranges`` has the rows and bytes of each shard and the least and greatest value of each dimension. New columns get
    underscores in front if their name is taken. Shards differ by one row at most; repeated rows each get a place.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    body = F.coalesce(F.col(named[text]).cast("string"), F.lit(""))
    rows = rows.withColumn("_size", F.octet_length(body).cast("bigint"))
    along = [*(named[c] for c in dimensions), "_size"]
    if bits * len(along) > CURVE_BITS:
        raise ValueError(f"{len(along)} dimensions of {bits} bits are more than {CURVE_BITS} bits")
    metadata = stage(rows.select(*along), "metadata")
    place = hilbert_place(metadata, along, bits=bits)
    keys = [named[c] for c in order]
    mixed = rows.withColumn("_curve", place).withColumn("_mix", F.shiftrightunsigned(F.xxhash64(*keys), 11))
    mixed = mixed.withColumn("_crc", F.crc32(F.encode(body, "utf-8")))
    cut = shard_runs(mixed, metadata.select("_size", place.alias("_curve")), ["_curve", "_mix", *keys, "_crc", "_size"], shards)
    shard, slot, curve = (free_name(docs, c) for c in ("shard", "slot", "curve_index"))
    whole = cut.sortWithinPartitions("_shard", "_slot").select(
        *[F.col(n).alias(c) for c, n in named.items()], F.col("_slot").alias(slot), F.col("_curve").alias(curve), F.col("_shard").alias(shard)
    )
    back = _stored(whole, f"{folder}/rows", partitionBy=shard)
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    ends = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))]
    ranges = back.groupBy(shard).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"), *ends, F.min(size).alias("min_size"), F.max(size).alias("max_size"))
    return back, _stored(ranges, f"{folder}/ranges")


def read_shards(spark: SparkSession, folder: str, *, text: str = "text", **wanted: tuple) -> DataFrame:
    """Rows of shards that :func:`write_shards` wrote with each dimension named between its two ends, both included.

    ``size`` is the bytes of ``text``. Shards whose ranges cannot hold such rows are not opened: the filter on the folder's partition
    column prunes their files. Rows with a null in a named dimension are not found. Nothing named gives all rows.
    """
    ranges = spark.read.parquet(f"{folder}/ranges")
    shard = ranges.columns[0]
    meets = F.lit(True)
    for c, (low, high) in wanted.items():
        meets = meets & (F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high))
    listed = [r[0] for r in ranges.where(meets).select(shard).collect()]  # one number per shard
    found = spark.read.parquet(f"{folder}/rows").where(F.col(shard).isin(listed))
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    for c, (low, high) in wanted.items():
        found = found.where((size if c == "size" else F.col(c)).between(F.lit(low), F.lit(high)))
    return found


def hilbert_shards(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text",
                   dimensions: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` as read back from its shard: key, size, text_crc32, law, shard, slot, grown_shard, curve_index.

    The shards are those of :func:`write_shards`, in the shared folder. The law is ``rows``: shards differ by one row at most. A
    null text has size 8 and checksum 0. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    back, _ = write_shards(docs, shards, new_folder(docs.sparkSession, "shards"), text=text, dimensions=dimensions, order=(key,), bits=bits)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slot, curve, shard = back.columns[-3:]
    return back.select(
        key, (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(curve).alias("curve_index"),
    )
