"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, prepare, texts_of
from reelbook.session import stage

#: Buckets of hashed words and word pairs.
BUCKETS = 1 << 16
#: Count given to each bucket beforehand, as a share of the mean count.
SMOOTHING = 0.01
#: Share of held-out target documents below the weight that sets the size of the sample.
TARGET_LOSS = 0.002
#: Values collected at the end of the search for the k-th; bins of a step before.
FEW_VALUES, BINS = 10_000, 1024
_WORDS = re.compile(r"\w+|[^\w\s]+")
#: Words a Python worker remembers.
_REMEMBERED = 500_000
_HASHES: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Buckets of the words, in their own case, and of the pairs of neighbours."""
    words = _WORDS.findall(text)
    if len(_HASHES) > _REMEMBERED:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(48)
    return np.concatenate([(one * np.uint64(0x9E3779B97F4A7C15)) >> shift, (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift]).astype(np.int64)


def _counts(rows: DataFrame) -> np.ndarray:
    """Counts of buckets over all rows of a table with ``text`` and ``target``: one array for all, one for the target."""
    out = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for target, text in texts_of(batch, "text", "target"):
                found = features(text)
                np.add.at(seen[0], found, 1)
                if target:
                    np.add.at(seen[1], found, 1)
        cells = np.flatnonzero(seen)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen.ravel()[cells])], schema=out)

    counts = np.zeros(2 * BUCKETS)
    for r in rows.select("text", "target").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]  # 2 * BUCKETS at most
    return counts.reshape(2, BUCKETS)


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share of the target over its share of the raw text."""
    smooth = counts + SMOOTHING * counts.mean(axis=1, keepdims=True) + 1e-9
    shares = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(shares[1]) - np.log(shares[0])


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a stored column, exactly: bins are counted in parallel and the right one opened."""
    if k <= 0:
        return None
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    while lo is not None and lo < hi:
        inside = values.where(F.col(column).between(lo, hi))
        step = (hi - lo) / BINS
        if not step > 0:
            break
        bin_ = F.least(F.floor((F.col(column) - lo) / step), F.lit(BINS - 1))
        above = values.where(F.col(column) > hi).count()
        found = sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        same = (r["lo"], r["hi"]) == (lo, hi)
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= FEW_VALUES or same:
            listed = sorted((x[0] for x in values.where(F.col(column).between(lo, hi)).select(column).limit(FEW_VALUES + 1).collect()), reverse=True)
            return listed[k - above - 1] if len(listed) <= FEW_VALUES else lo
    return lo


def quality_sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """Weight of every document and whether it is in the sample: key, log_weight, gumbel_key, kept.

    The target is half of the labelled text of good quality that is not toxic, the raw text all documents; a document's log weight is
    the sum of the log ratios of its words and word pairs. Sampling without replacement in proportion to the weights takes the
    ``k`` greatest of log weight plus Gumbel noise, which depends on the key alone. ``k`` is the number of documents whose weight
    reaches that of all but ``TARGET_LOSS`` of the other half of the target, which no model has seen. Without target rows all are kept. An empty or null text
    has weight 0; repeated rows share their noise, so they stay or go together. A key labelled several times is target only if all labels say so.
    """
    prepare(docs.sparkSession)
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_key")).agg(
        F.coalesce(F.min(F.col("quality")) >= 1, F.lit(False)).alias("_q"), F.coalesce(F.max(F.col("toxic")) >= 1, F.lit(False)).alias("_t")
    ).select("_key", (F.col("_q") & ~F.col("_t")).alias("target"))
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).cast("string").alias("text"))
    first_half = F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(2)) == 0
    ratios = log_ratios(_counts(rows.join(good.withColumn("target", F.col("target") & first_half), "_key", "left")))
    out = pa.schema([("_key", pa.int64()), ("log_weight", pa.float64())])

    def run(batches):
        yield from batches_of(out, ((k, float(ratios[features(t)].sum())) for b in batches for k, t in texts_of(b, "text", "_key")))

    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))))
    weighed = stage(rows.mapInArrow(run, "_key bigint, log_weight double").withColumn("gumbel_key", F.col("log_weight") + noise), "weights")
    cut = weighed.join(good.where(F.col("target") & ~first_half), "_key").agg(F.percentile_approx("log_weight", TARGET_LOSS, 10_000)).first()[0]
    k = weighed.where(F.col("log_weight") >= cut).count() if cut is not None else 0
    bar = kth_largest(weighed, "gumbel_key", k) if cut is not None else float("-inf")
    kept = F.lit(True) if cut is None else F.col("gumbel_key") >= F.lit(bar)
    return weighed.select(F.col("_key").alias(key), "log_weight", "gumbel_key", kept.alias("kept"))
