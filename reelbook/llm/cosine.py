"""Near-duplicate embeddings: tiles of cells along the principal axes, compared leading axes first.

Unit vectors are turned into the principal axes of all vectors. The products of the leading axes are added up first; what the
others can add is at most the product of the two vectors' norms over them (Cauchy and Schwarz), so nearly all pairs are given up
there. Tiles are cells along the leading axes, kept in files of the shared folder with the range of each coordinate; two tiles
that lie too far apart for any link are not compared, the others are read where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import components, open_input, open_output, prepare, shared_files, unique_file
from reelbook.llm.vectors import usable
from reelbook.session import stage

#: Vectors of a tile, about.
TILE = 4096
#: Rows of a tile whose products are held at a time.
STRIP = 256
#: Rows a tile should have in the sample that places the cuts between cells, and rows of the sample at most. Cells say how soon
#: two tiles are told apart; what is compared does not hang on them.
SAMPLED, SAMPLE = 64, 1 << 16
#: Tiles a task compares with one tile, and tasks at most.
RUN, TASKS = 4, 20_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Principal axes of all unit vectors of a dimension, by descending variance, their shares of it, and the number of vectors.

    One ``dim`` x ``dim`` sum per task, added up.
    """
    out = pa.schema([("cell", pa.int32()), ("total", pa.float64())])

    def sums(batches):
        total = np.zeros(dim * dim + 1)
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0)))
                total[:-1] += (u.T @ u).ravel()
                total[-1] += len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total)], schema=out)

    found = vectors.select("vector").mapInArrow(sums, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(dim * dim + 1)
    for r in found:  # dim * dim + 1 numbers
        total[r["cell"]] = r["total"]
    shares, axes = np.linalg.eigh(total[:-1].reshape(dim, dim) / total[-1])
    return np.ascontiguousarray(axes[:, ::-1]), np.maximum(shares[::-1], 0), int(total[-1])


def leading_axes(shares: np.ndarray, least: float) -> int:
    """Axes to look at first: as many as give up a pair of ordinary vectors, its leading product three deviations above none."""
    bound = 1 - np.cumsum(shares) + 3 * np.sqrt(np.cumsum(shares * shares))
    enough = np.nonzero(bound <= least)[0]
    return int(enough[0]) + 1 if len(enough) else len(shares)


def coordinates(unit: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """Places on the leading axes and, last, the norm over the others: never farther apart than the vectors are."""
    turned = unit @ axes[:, :leading]
    rest = unit @ axes[:, leading:]
    return np.concatenate([turned, np.sqrt((rest * rest).sum(axis=1, keepdims=True))], axis=1).astype(np.float32)


def room(leading: int) -> float:
    """What rounding to single precision can take from a sum over the coordinates of unit vectors."""
    return (leading + 8) * 2.0**-22


def linked_pairs(one: np.ndarray, other: np.ndarray, near_one: np.ndarray, near_other: np.ndarray, least: float, same: bool):
    """Pairs (rows of one, of other) with cosine ``least`` or more, a strip of ``one`` at a time. Of one tile i < j.

    ``one`` and ``other`` hold unit vectors in the given coordinates, which decide; ``near_one`` and ``near_other`` their
    ``coordinates``.
    """
    width = -(-len(other) // 8) * 8
    across = np.zeros((near_other.shape[1], width), np.float32)
    across[:, : len(other)] = near_other.T
    bar = np.float32(least - room(near_one.shape[1]))
    for at in range(0, len(one), STRIP):
        likely = near_one[at : at + STRIP] @ across >= bar
        eights = np.flatnonzero(likely.reshape(-1).view(np.uint64))  # nearly all are empty
        which, place = np.nonzero(likely.reshape(-1, 8)[eights])
        i, j = np.divmod(eights[which] * 8 + place, width)
        keep = (i + at < j) & (j < len(other)) if same else j < len(other)
        i, j = i[keep] + at, j[keep]
        for cut in range(0, len(i), 1 << 15):
            p, q = i[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            keep = np.einsum("ij,ij->i", one[p], other[q]) >= least
            yield p[keep], q[keep]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (least number of the component of each number) once i and j are linked as well."""
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


# Tiles -----------------------------------------------------------------------------------------------------------------


class Cells:
    """Cells that halve the leading coordinates again and again where they spread most; ``tiles`` in all, of like size."""

    def __init__(self, sample: np.ndarray, tiles: int):
        self.axis, self.cut, self.below, self.above, self.first, self.parts = [], [], [], [], [], []
        self.tiles = 0
        self._grow(sample, tiles)
        self._made = [np.array(x) for x in (self.axis, self.cut, self.below, self.above, self.first, self.parts)]

    def _grow(self, sample: np.ndarray, tiles: int) -> int:
        me = len(self.axis)
        for x in (self.axis, self.cut, self.below, self.above, self.first, self.parts):
            x.append(0)
        self.axis[me] = -1
        if tiles > 1 and len(sample) >= SAMPLED:
            axis = int(sample.var(axis=0).argmax())
            cut = np.quantile(sample[:, axis], (tiles // 2) / tiles, method="lower")
            low = sample[:, axis] <= cut
            if not low.all():
                share = min(tiles - 1, max(1, round(tiles * low.mean())))
                self.axis[me], self.cut[me] = axis, float(cut)
                self.below[me] = self._grow(sample[low], share)
                self.above[me] = self._grow(sample[~low], tiles - share)
                return me
        self.first[me], self.parts[me] = self.tiles, tiles
        self.tiles += tiles
        return me

    def tile(self, near: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Tile of each row. A cell that could not be cut further is dealt to its tiles by a hash of the node."""
        axis, cut, below, above, first, parts = self._made
        at = np.zeros(len(near), np.int64)
        while (inner := np.flatnonzero(axis[at] >= 0)).size:
            here = at[inner]
            at[inner] = np.where(near[inner, axis[here]] <= cut[here], below[here], above[here])
        dealt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return first[at] + (dealt % parts[at].astype(np.uint64)).astype(np.int64)


def cells_of(vectors: DataFrame, axes: np.ndarray, leading: int, n: int) -> Cells:
    """Cells for ``n`` vectors, cut at the quantiles of a bounded sample."""
    tiles = max(1, -(-n // TILE))
    if tiles == 1:
        return Cells(np.zeros((0, leading + 1)), 1)

    def coordinates_of(batches):
        for batch in batches:
            if batch.num_rows:
                near = coordinates(_unit(_matrix(batch.column(0))), axes, leading)
                yield pa.RecordBatch.from_arrays([pa.array(near.tolist(), pa.list_(pa.float32()))], names=["near"])

    drawn = vectors.sample(min(1.0, min(SAMPLED * tiles, SAMPLE) / n), seed=7).select("vector")
    rows = drawn.mapInArrow(coordinates_of, "near array<float>").collect()  # about SAMPLE short rows at most
    return Cells(np.array([r["near"] for r in rows], dtype=np.float32).reshape(-1, leading + 1), tiles)


def _fixed(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1])


def tile_files(vectors: DataFrame, cells: Cells, axes: np.ndarray, leading: int) -> DataFrame:
    """Writes the tiles; one row per tile: tile, path, and the least and greatest value of each coordinate (lo, hi)."""
    folder = shared_files(vectors.sparkSession, "cosine-tiles")
    placed_schema = pa.schema([("tile", pa.int64()), ("node", pa.int64()), ("m", pa.int64()), ("vector", pa.list_(pa.float64()))])
    out = pa.schema([("tile", pa.int64()), ("path", pa.string()), ("lo", pa.list_(pa.float32())), ("hi", pa.list_(pa.float32()))])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                node, m, vector = batch.columns
                tile = cells.tile(coordinates(_unit(_matrix(vector)), axes, leading), node.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(tile), node, m, vector.cast(pa.list_(pa.float64()))], schema=placed_schema)

    def write(rows: pa.Table) -> pa.Table:
        unit = _unit(_matrix(rows.column("vector")))
        near = coordinates(unit, axes, leading)
        path = unique_file(folder, "tile", ".arrow")
        kept = pa.table([rows.column("node"), rows.column("m"), _fixed(unit), _fixed(near)], names=["node", "m", "unit", "near"])
        with open_output(path) as stream, pa.ipc.new_file(stream, kept.schema) as file:
            file.write_table(kept)
        tile = rows.column("tile")[0].as_py()
        return pa.table([pa.array(x, t.type) for x, t in zip(([tile], [path], [near.min(axis=0).tolist()], [near.max(axis=0).tolist()]), out)], schema=out)

    placed = vectors.select("node", "m", "vector").mapInArrow(place, "tile bigint, node bigint, m bigint, vector array<double>")
    return placed.groupBy("tile").applyInArrow(write, "tile bigint, path string, lo array<float>, hi array<float>")


def _read_tile(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    with open_input(path) as stream:
        found = pa.ipc.open_file(stream).read_all().combine_chunks()
    matrix = lambda c: (x := found.column(c).chunk(0)).flatten().to_numpy().reshape(len(x), -1)
    return found.column("node").to_numpy(), found.column("m").to_numpy(), matrix("unit"), matrix("near")


def _near_tiles(tiles: DataFrame, least: float, leading: int) -> DataFrame:
    """Tiles to compare with each other or themselves, up to ``RUN`` with one: path and others (paths)."""
    left, right = tiles.toDF("tile_a", "path", "lo_a", "hi_a"), tiles.toDF("tile_b", "other", "lo_b", "hi_b")
    less = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") - q)
    gap = F.zip_with(less("lo_a", "hi_b"), less("lo_b", "hi_a"), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    # Unit vectors with cosine c lie sqrt(2 - 2 c) apart at most, and so do their coordinates.
    reach = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= 2 - 2 * least + room(leading)
    pairs = left.join(right, (F.col("tile_a") <= F.col("tile_b")) & reach)
    return pairs.groupBy("tile_a", "path", F.expr(f"tile_b div {RUN}")).agg(F.collect_list("other").alias("others")).select("path", "others")


#: What a comparison gives: links of a vector (kind 0) and edges of a forest (kind 1).
RESULTS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _results(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], schema=RESULTS)


def _comparer(least: float):
    """Compares a tile with others: the number of links of each vector, and stars that hold together what the links do."""

    def compare(batches):
        for batch in batches:
            for path, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node, m, unit, near = _read_tile(path)
                links = np.zeros(len(node), np.int64)
                for other in others:
                    same = other == path
                    node_b, m_b, unit_b, near_b = (node, m, unit, near) if same else _read_tile(other)
                    links_b = links if same else np.zeros(len(node_b), np.int64)
                    shift = 0 if same else len(node)
                    root = np.arange(shift + len(node_b))
                    for i, j in linked_pairs(unit, unit_b, near, near_b, least, same):
                        np.add.at(links, i, m_b[j])
                        np.add.at(links_b, j, m[i])
                        root = join_roots(root, i, j + shift)
                    if not same and (some := np.flatnonzero(links_b)).size:
                        yield _results(0, node_b[some], links_b[some])
                    both = node if same else np.concatenate([node, node_b])
                    if (tied := np.flatnonzero(root != np.arange(len(root)))).size:
                        yield _results(1, both[root[tied]], both[tied])
                if (some := np.flatnonzero(links)).size:
                    yield _results(0, node[some], links[some])

    return compare


def near_duplicate_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """Links between vectors of the same dimension with cosine ``least`` or more: key, n_links, component_id, kept.

    One row per row of ``rows``. Unusable and zero vectors link with nothing; a repeated key is one vector; a null key has no
    links and no component. Equal vectors are one from the start and count with their number. Pairs never leave the task that
    finds them: it gives the number of links per vector and a spanning forest.
    """
    prepare(rows.sparkSession)
    vectors = usable(rows, key, vector).where(F.exists("vector", lambda x: x != 0))
    classes = stage(vectors.groupBy("vector", "dim").agg(F.min("key").alias("node"), F.count("*").alias("m")), "classes")
    members = stage(vectors.select("key", "vector").join(classes.select("vector", "node", "m"), "vector").select("key", "node", "m"), "members")
    results = None
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]  # one per vector length there is
    for dim in sorted(dims):
        own = classes.where(F.col("dim") == dim)
        axes, shares, n = principal_axes(own, dim)
        leading = leading_axes(shares, least)
        tiles = stage(tile_files(own, cells_of(own, axes, leading, n), axes, leading), "tiles")
        runs = stage(_near_tiles(tiles, least, leading), "runs")  # tiles, not vectors
        done = runs.repartition(max(1, min(runs.count(), TASKS))).mapInArrow(_comparer(least), "kind int, a bigint, b bigint")
        results = done if results is None else results.unionByName(done)
    ids = rows.select(F.col(key).cast("bigint").alias("key"))
    if results is None:
        return ids.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    results = stage(results, "links")
    counts = results.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    groups = components(results.where("kind = 1").select("a", "b"), "cosine")
    nodes = members.join(counts.withColumnRenamed("a", "node"), "node", "left").join(groups, "node", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    whole = ids.join(nodes, "key", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "key").alias("component_id")
    )
    return whole.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
