"""Exact top-k inner products by an impact-ordered index, score at a time.

Components are the terms of the index, their values the impacts: a posting segment holds the vectors of a block whose value in
one dimension falls into one quantised level. For a query the segments of all dimensions are processed by descending impact.
Contributions are counted from the least a vector of the block can get in a dimension, so they are never negative; with the
impacts still open in each dimension a vector's sum so far tells the most its score can be. Processing ends only when that
proves all but a few vectors out of the top k; these are scored exactly from their components. Queries go through the segments
in groups: a segment's postings are read once and added for all of a group that have reached its impact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, prepare
from reelbook.llm.vectors import usable

#: Vectors of a block, whose index a task holds; queries a task meets at once; queries that go through the segments together.
BLOCK_VECTORS, QUERY_BATCH, GROUP = 16384, 1024, 128
#: Levels the values of a dimension are quantised to.
LEVELS = 32
#: Share of the postings processed before each look at the bounds.
LOOKS = (3 / 4, 1.0)
#: Possible members few enough to be scored: this share of the block, or this many. Promising ones are scored for the bar.
FEW_SHARE, FEW, PROMISING = 1 / 16, 256, 32


class ImpactIndex:
    """Index of the integer vectors of one block: per dimension and level a segment of postings."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        self.keys, self.vectors = keys, vectors
        self.n, self.dims = vectors.shape
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (vectors - self.low) // width
        order = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
        self.sizes = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(self.dims)])
        self.segments = [part for d in range(self.dims) for part in np.split(order[d], np.cumsum(self.sizes[d])[:-1])]
        first = self.low[:, None] + np.arange(LEVELS) * width[:, None]
        #: Least and greatest value of a segment.
        self.least, self.most = np.minimum(first, self.high[:, None]), np.minimum(first + width[:, None] - 1, self.high[:, None])
        self.greatest = int(np.abs(vectors).max(initial=0))

    def top(self, keys: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query's key, key, score) of the best ``k`` vectors but the query's own for each query, ties to the smaller key."""
        for at in range(0, len(keys), GROUP):
            yield from self._group(keys[at : at + GROUP], queries[at : at + GROUP], k)

    def _group(self, keys: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        # Impacts above the least contribution of the dimension, at least and at most for the vectors of a segment.
        weight = queries.T[:, None, :]
        floor = np.minimum(queries * self.low, queries * self.high)
        one, other = (weight * ends[:, :, None] - floor.T[:, None, :] for ends in (self.least, self.most))
        lower, upper = np.minimum(one, other), np.maximum(one, other)
        order = np.argsort(-upper.reshape(-1, len(keys)), axis=0, kind="stable")
        ranked = np.take_along_axis(upper.reshape(-1, len(keys)), order, axis=0)
        reached = np.cumsum(self.sizes.ravel()[order], axis=0)
        waiting = np.arange(len(keys))
        for share in LOOKS:
            low, up = lower[:, :, waiting], upper[:, :, waiting]
            # The impact down to which each query has processed its segments, and what it has left open in each dimension.
            at = (reached[:, waiting] < share * self.n * self.dims).sum(axis=0)
            bar = np.where(at < len(ranked), ranked[np.minimum(at, len(ranked) - 1), waiting], -1) if share < 1 else np.full(len(waiting), -1)
            done = up > bar
            rest = np.where(done, 0, up).max(axis=1)
            sums = self._process(np.where(done, low - rest[:, None, :], 0), done, up)
            # A vector's score is at most its sum, what is open, and what quantisation hides.
            hidden = (np.where(done, up - low, 0).max(axis=1) + rest).sum(axis=0) + floor[waiting].sum(axis=1)
            later = []
            for i, q in enumerate(waiting.tolist()):
                possible = self._possible(sums[i], int(hidden[i]), queries[q], keys[q], k)
                if share < 1 and len(possible) > max(FEW, k, self.n * FEW_SHARE):
                    later.append(q)
                    continue
                scores = self.vectors[possible] @ queries[q]
                best = np.lexsort((self.keys[possible], -scores))[:k]
                yield from ((int(keys[q]), int(self.keys[possible[j]]), int(scores[j])) for j in best)
            waiting = np.array(later, np.int64)
            if not len(waiting):
                return

    def _process(self, gain: np.ndarray, done: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Gains of all vectors for each query, segment by segment in descending impact; what no query has reached is left out."""
        queries = gain.shape[2]
        flat, wanted = gain.reshape(-1, queries), np.flatnonzero(done.reshape(-1, queries).any(axis=1) & (self.sizes.ravel() > 0))
        wanted = wanted[np.argsort(-upper.reshape(-1, queries)[wanted].max(axis=1), kind="stable")]
        small = int(np.abs(flat).max(initial=0)) * self.dims < 1 << 31
        flat = flat.astype(np.int32) if small else flat
        sums = np.zeros((self.n, queries), flat.dtype)
        for s in wanted.tolist():
            sums[self.segments[s]] += flat[s]
        return np.ascontiguousarray(sums.T)

    def _possible(self, sums: np.ndarray, hidden: int, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Vectors not proven to be outside the best ``k``: the bar is the k-th best exact score of promising ones."""
        others = self.keys != own
        if np.count_nonzero(others) <= k:
            return np.flatnonzero(others)
        n = min(self.n, PROMISING + k + 1)
        promising = np.argpartition(sums, self.n - n)[self.n - n :]
        promising = promising[others[promising]]
        known = np.sort(self.vectors[promising] @ query)[::-1]
        if len(known) < k:
            return np.flatnonzero(others)
        return np.flatnonzero((sums >= int(known[k - 1]) - hidden) & others)


def exact_top_k(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` best scores of each query: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``. Queries are the vectors whose key is divisible by ``every``; candidates all vectors
    of the same dimension but those with the query's own key. Unusable vectors (null, with a null or non-finite component, or
    without components) take no part; repeated keys count once. Scores must fit 64 bits. Blocks of vectors meet batches of
    queries, both of bounded size; each block gives its best ``k``, of which the best are taken.
    """
    prepare(rows.sparkSession)
    whole = usable(rows, key, vector).select("key", "dim", F.transform("vector", lambda x: F.floor(x * scale)).cast("array<bigint>").alias("v"))
    n = rows.count()
    blocks, batches = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-n // every // QUERY_BATCH))
    place = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(m)).cast("int")
    base = whole.select("*", place(1, blocks).alias("block"), place(2, batches).alias("batch"))
    left = base.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = base.where(F.col("key") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64)
        return table.column("key").to_numpy(), values.reshape(table.num_rows, -1)

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return out.empty_table()
        index = ImpactIndex(*matrix(candidates))
        return pa.Table.from_batches(batches_of(out, index.top(*matrix(queries), k)), out)

    at = ["dim", "block", "batch"]
    best = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
