"""Which documents have nearly the same word shingles: an exact Jaccard join by combinations of prefix shingles.

All shingles have one global order, the rare before the frequent. Two sets that are similar enough share most of their
shingles, so a short *prefix* of each must meet the other's. A rare shingle in a prefix is a signature by itself. Frequent
ones, dealt into classes, count in pairs: the prefix is extended until dropping the first of each class still leaves enough,
so two similar sets share a rare shingle or two frequent ones of a class, and a passage that very many documents hold brings
together only those whose prefixes hold two of its shingles. Sets that share a signature are verified on their whole texts.

Equal sets are one *node* from the start. Sets that share a signature are not all compared with each other: each is compared
with one of them, the hub, and where that ties them together no other pair matters to the components. What is still apart is
compared with some other hubs, and once few pairs are left between different components, all of them are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, components, prepare, texts_of
from reelbook.llm.shingles import mix, shingle_set
from reelbook.session import stage

_U = np.uint64
#: Bits of a shingle's hash that name its frequency counter; counters of a block, which are summed together.
SKETCH_BITS, BLOCK = 20, 1 << 12
#: A shingle is frequent if its counter lies above the mean counter by this many of its standard deviations and this much.
FREQUENT_DEVIATIONS, FREQUENT_ABOVE = 4, 8
#: Frequent shingles of a set per class of pairs, about.
CLASS_SIZE = 50
#: All pairs left between components are compared once they are at most this many times the rows they come from, or once a
#: turn of several hubs has left more than half of them.
PAIRS_PER_ROW = 32
#: Hubs of a signature from the second turn on.
HUBS = 4


def _prefix_signatures(shingles: np.ndarray, frequent: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Signatures of a set; two sets of similarity ``least`` (numerator, denominator) or more have one in common.

    A partner's overlap is at least ``ceil(t n)``, so of any ``n - ceil(t n) + 1`` shingles one is shared; counting a class of
    frequent shingles as one less than it has, two of a class are.
    """
    n, (num, den) = len(shingles), least
    if n < 2:  # a single shingle is similar to its equal only
        return shingles[:0]
    need = n - -(-num * n // den) + 1
    common = frequent[(shingles >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    rare = shingles[~common]
    if len(rare) >= need:
        return rare[:need]
    need -= len(rare)
    often = shingles[common]
    level = n.bit_length() - 1
    found = [rare]
    # A partner may be of the level below, whose classes are fewer.
    for own in (level, level - 1) if -(-num * n // den) < 1 << level else (level,):
        classes = max(1, (1 << own) // CLASS_SIZE)
        of = (mix(often ^ _U(own + 1)) % _U(classes)).astype(np.int64)
        first = np.zeros(len(often), bool)
        first[np.unique(of, return_index=True)[1]] = True
        size = int(np.searchsorted(np.cumsum(~first), need)) + 1
        if size > len(often):
            raise AssertionError("more classes than the prefix can spare")
        order = np.argsort(of[:size], kind="stable")
        taken, starts = often[:size][order], np.flatnonzero(np.diff(of[:size][order], prepend=-1))
        for a, b in zip(starts, [*starts[1:], size]):
            i, j = np.triu_indices(b - a, 1)
            part = taken[a:b]
            found.append(mix(part[i] * _U(0x9E3779B97F4A7C15) + mix(part[j] + _U(own + 1))))
    return np.unique(np.concatenate(found))


def _summed(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks of counters added up by keys (the first is ``block``)."""

    def add(table: pa.Table) -> pa.Table:
        counts = [np.frombuffer(v.as_buffer(), "<u4" if len(v.as_buffer()) == 4 * BLOCK else "<i8") for v in table.column("counts")]
        total = np.sum(counts, axis=0, dtype="<i8")
        return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    return blocks.groupBy(*keys).applyInArrow(add, "block int, part int, counts binary")


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Which counters of the frequency sketch are frequent, over the shingles of all rows.

    Each task counts into the whole sketch and gives it as blocks; blocks are summed in two steps, so a task meets about the
    square root of the number of tasks. The sketch has a fixed size, 8 MB, with which it also reaches the driver.
    """
    out = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    groups = max(1, round(texts.rdd.getNumPartitions() ** 0.5))

    def count(batches):
        seen, waiting, held = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def add():
            if waiting:
                seen[:] += np.bincount((np.concatenate(waiting) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(seen))

        for batch in batches:
            for (text,) in texts_of(batch, "text"):
                waiting.append(shingle_set(text, words))
                held += len(waiting[-1])
                if held >= 1 << SKETCH_BITS:
                    add()
                    waiting, held = [], 0
        add()
        part = TaskContext.get().partitionId() % groups
        rows = ((i, part, block.astype("<u4").tobytes()) for i, block in enumerate(seen.reshape(-1, BLOCK)) if block.any())
        yield from batches_of(out, rows, size=32)

    blocks = texts.select("text").mapInArrow(count, "block int, part int, counts binary")
    counts = np.zeros((1 << SKETCH_BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for row in _summed(_summed(blocks, "block", "part"), "block").collect():
        counts[row["block"]] = np.frombuffer(row["counts"], "<i8")
    counts = counts.ravel()
    mean = counts.mean()
    return counts > mean + FREQUENT_DEVIATIONS * mean**0.5 + FREQUENT_ABOVE


def _profile(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of some bins by their hash: a few per bin, so that sets are told apart by it."""
    bins = 1 << min(11, max(4, len(shingles).bit_length() - 3))
    counts = np.bincount((shingles & _U(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


#: 64-bit words of a parity map.
PARITY_WORDS = 8


def _parity(shingles: np.ndarray) -> np.ndarray:
    """A bit per slot, whether an odd number of shingles falls there. Maps differ in at most as many bits as sets in shingles."""
    slots = 64 * PARITY_WORDS
    odd = np.bincount(((shingles >> _U(20)) % _U(slots)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _may_share(one: bytes, other: bytes) -> int | None:
    """The most two sets can have in common by their profiles; None if a profile says nothing."""
    if not one or not other:
        return None
    if len(one) > len(other):
        one, other = other, one
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(axis=0)
    return int(np.minimum(a, b).sum())


def _facts(texts: DataFrame, words: int, least: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """key, n (size of the set), print (fingerprint of the set, null if empty), profile, parity, signatures."""
    out = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("profile", pa.binary()), ("parity", pa.list_(pa.int64())), ("signatures", pa.list_(pa.int64()))])

    def run(batches):
        def rows():
            for batch in batches:
                for key, text in texts_of(batch, "text", "key"):
                    found = shingle_set(text, words)
                    mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                    yield key, len(found), mark, _profile(found), _parity(found), _prefix_signatures(found, frequent, least).view(np.int64)

        yield from batches_of(out, rows(), weight=lambda r: 8 * len(r[5]))

    return texts.mapInArrow(run, "key bigint, n bigint, print binary, profile binary, parity array<bigint>, signatures array<bigint>")


def _promising(pairs: DataFrame, profiles: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that can be similar enough by their profiles; no similar pair is lost."""
    num, den = least
    of = lambda c: profiles.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("profile").alias(f"of_{c}"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        def rows():
            for batch in batches:
                for a, b, n_a, n_b, one, other in zip(*[c.to_pylist() for c in batch.columns]):
                    most = _may_share(one, other)
                    if most is None or (num + den) * most >= num * (n_a + n_b):
                        yield a, b

        yield from batches_of(out, rows())

    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "of_a", "of_b")
    return both.mapInArrow(check, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, words: int, least: tuple[int, int], label: str) -> DataFrame:
    """Pairs (a, b) of keys whose whole texts are similar enough. The text of a hub is met once per pair, not gathered."""
    num, den = least
    of_b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    both = pairs.hint("merge").join(of_b, "b").hint("merge").join(of_a, "a").select("a", "b", "text_a", "text_b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        def rows():
            hub = one = None
            for batch in batches:
                for a, b, first, text in texts_of(batch, "text_b", "a", "b", "text_a"):
                    if first != hub:
                        hub, one = first, shingle_set(first, words)
                    other = shingle_set(text, words)
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    if den * shared >= num * (len(one) + len(other) - shared):
                        yield a, b

        yield from batches_of(out, rows())

    return stage(both.mapInArrow(check, "a bigint, b bigint"), label)


def _fitting(least: tuple[int, int]):
    """Sizes of two sets that can be similar enough at all."""
    return F.lit(least[1]) * F.least("n_a", "n_b") >= F.lit(least[0]) * F.greatest("n_a", "n_b")


def _stars(rows: DataFrame, turn: int, hubs: int = 1) -> DataFrame:
    """hub, n_hub, key, n, component: each set under the hubs of each of its signatures.

    The hubs of a turn go by one order each, so they are few, and many signatures shared by the same sets become one star. Sets
    that share a signature share a star.
    """
    whole = Window.partitionBy("signature")
    first = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(i), "key").alias("mark"), "key", "n")).over(whole) for i in range(hubs)]
    under = rows.withColumn("_hubs", F.array(*first)).withColumn("_hub", F.explode("_hubs"))
    return under.select(F.col("_hub.key").alias("hub"), F.col("_hub.n").alias("n_hub"), "key", "n", "component").distinct()


def _hub_pairs(stars: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Each set with its hubs, as far as their sizes fit."""
    pairs = stars.select(F.col("hub").alias("a"), F.col("n_hub").alias("n_a"), F.col("key").alias("b"), F.col("n").alias("n_b"))
    return pairs.where((F.col("a") != F.col("b")) & _fitting(least)).select("a", "b")


def _pairs_between(stars: DataFrame, profiles: DataFrame, least: tuple[int, int]) -> DataFrame:
    """All pairs of a star between different components whose parity maps allow them to be similar enough."""
    num, den = least
    words = [F.element_at("parity", i + 1) for i in range(PARITY_WORDS)]
    owned = stars.join(profiles.select("key", *[w.alias(f"p{i}") for i, w in enumerate(words)]), "key")
    of = lambda c: owned.select("hub", F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in owned.columns if x not in ("hub", "key")])
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITY_WORDS)), F.lit(0))
    # Of similar sets at most (den - num) / (den + num) of all their shingles are in one only.
    near = F.lit(num + den) * differ <= F.lit(den - num) * (F.col("n_a") + F.col("n_b"))
    between = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & _fitting(least) & near
    return of("a").join(of("b"), "hub").where(between).select("a", "b").distinct()


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the signatures whose sets lie in several components, with the component."""
    known = groups.select(F.col("node").alias("key"), F.col("component").alias("_c"))
    owned = rows.join(known, "key", "left").withColumn("component", F.coalesce("_c", "key")).drop("_c")
    whole = Window.partitionBy("signature")
    ends = owned.withColumn("_lo", F.min("component").over(whole)).withColumn("_hi", F.max("component").over(whole))
    return ends.where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """Components of the links between documents whose shingle sets have Jaccard similarity ``least`` or more.

    Returns key, n_shingles, component_id for every row of ``docs``. Exact up to collisions of 64-bit hashes within a pair of
    sets and of 128-bit hashes between sets. Texts are lowered in A-Z and cut at ASCII white space; null and empty texts have no shingles and link with nothing. A
    repeated key is one node with all its texts. A row without key goes with the rows of an equal set, or has no component.
    """
    if not least[1] < 2 * least[0] <= 2 * least[1]:
        raise ValueError("similarity must be above one half")
    prepare(docs.sparkSession)
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    facts = stage(_facts(texts, words, least, _frequent(texts, words)), "facts")
    sets = facts.where(F.col("n") > 0)
    nodes = stage(sets.where(F.col("key").isNotNull()).groupBy("print").agg(
        F.min("key").alias("node"), F.min("n").alias("n"), F.min_by(F.struct("profile", "parity", "signatures"), "key").alias("_of")
    ), "nodes")
    rows = nodes.select(F.col("node").alias("key"), "n", F.explode("_of.signatures").alias("signature"))
    both = Window.partitionBy("signature")
    shared = rows.withColumn("_lo", F.min("key").over(both)).withColumn("_hi", F.max("key").over(both))
    shared = stage(shared.where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi"), "shared")
    # No side of a join with texts has a bound on its size, so none is broadcast: small and large inputs take one plan.
    candidates = shared.select("key").distinct()
    held = stage(texts.join(candidates.hint("merge"), "key", "left_semi"), "held")
    profiles = stage(nodes.select(F.col("node").alias("key"), "n", "_of.profile", "_of.parity").join(candidates, "key", "left_semi"), "profiles")

    # A repeated key ties all sets it has.
    members = nodes.select("print", "node")
    several = sets.groupBy("key").agg(F.min("print").alias("_lo"), F.max("print").alias("_hi")).where(F.col("_lo") < F.col("_hi")).select("key")
    links = stage(sets.join(several, "key", "left_semi").join(members, "print").select(F.col("key").alias("a"), F.col("node").alias("b")), "links")
    groups, left, turn, before = components(links, "near"), shared.withColumn("component", F.col("key")), 0, float("inf")
    while True:
        stars = stage(_stars(left, turn), "stars")
        sizes = stars.groupBy("hub", "component").agg(F.count("*").alias("c")).groupBy("hub")
        per = sizes.agg(F.sum("c").alias("n"), ((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", 2))) / 2).alias("pairs"))
        n_rows, n_pairs = per.agg(F.sum("n"), F.sum("pairs")).first()
        if not n_rows:
            break
        last = turn > 0 and (n_pairs <= PAIRS_PER_ROW * n_rows or (turn > 1 and n_pairs > before / 2))
        if last:
            found = _pairs_between(stars, profiles, least)
        else:
            found = _hub_pairs(stars if turn == 0 else _stars(left, turn, HUBS), least)
        found = stage(_promising(found, profiles, least), "pairs")
        needed = found.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        links = links.unionByName(_verify(found, stage(held.join(needed.hint("merge"), "key", "left_semi"), "texts"), words, least, "links"))
        groups = components(links, "near")
        if last:
            break
        left, before = stage(_apart(left.select("signature", "key", "n"), groups), "apart"), n_pairs
        turn += 1
    final = members.join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "print", F.coalesce("component", "node").alias("_component")
    )
    placed = facts.select("key", "n", "print").join(final, "print", "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("_component"))
    return placed.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_each_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """Rows of ``docs`` less near-duplicates: of each component the document with the least key stays, once.

    Rows without key stay, as nothing tells their copies from themselves.
    """
    found = near_duplicates(docs.select(key, text), key=key, text=text, words=words, least=least)
    heads = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_head")).distinct()
    named = docs.join(heads, docs[key].cast("bigint") == F.col("_head"))
    turn = F.row_number().over(Window.partitionBy("_head").orderBy(text))
    once = named.withColumn("_turn", turn).where(F.col("_turn") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return once.unionByName(docs.where(F.col(key).isNull()))
