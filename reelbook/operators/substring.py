"""Which patterns occur inside which texts, as equi-joins.

A substring test between two tables would compare every pair. Instead each pattern is keyed by its anchor, its longest prefix whose
length is a power of two, and a bitmap of fixed size holds which hashes anchors have. Every place of a text is looked up in the bitmap where
the text is read; nearly all places end there. Only the places that pass, as (hash, text, position), are moved to meet the anchors, and
where an anchor is known the text yields the candidate strings of the lengths wanted there, which meet the patterns by equality. Work grows
with the characters of the texts, never with texts times patterns, and no pair that is not a true occurrence reaches a result: a bit
or a hash set by chance gives a candidate that equals no pattern.

Patterns are staged and measured. Anchors of small ones are broadcast themselves in place of the bitmap, and places are not moved at all; others are
joined by sorting. Anchors are unique there, so a common one can only make the side of the places heavy: how often a hash is hit is counted, and hits of a common one are
dealt to as many tasks as they fill. (Spark cannot foresee how many places a text has, so no join with them is left to an estimate.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.session import stage, stage_measured

#: Bits of the map of anchor hashes: half a megabyte, whatever the number of patterns.
BITS = 1 << 22
#: Hits of one anchor hash a task takes.
TASK_HITS = 200_000


def _anchors(patterns: DataFrame) -> DataFrame:
    """Anchors of the patterns: _hash, _span, _lengths (of the patterns that begin with it, at most ``_span`` different ones)."""
    length = F.length("pattern")
    spans = patterns.where(length > 0).select(
        length.alias("_length"), F.expr("shiftleft(1, length(bin(length(pattern))) - 1)").alias("_span"), "pattern")
    keyed = spans.select(F.expr("xxhash64(substring(pattern, 1, _span))").alias("_hash"), "_span", "_length")
    return keyed.groupBy("_hash", "_span").agg(F.collect_set("_length").alias("_lengths"))


def _bitmap(anchors: DataFrame) -> Column:
    """Which hashes occur, as one array of 64-bit words."""
    place = anchors.select((F.col("_hash").bitwiseAND(F.lit(BITS - 1))).alias("_place"))
    word, bit = F.shiftright("_place", 6).alias("_word"), F.expr("shiftleft(1L, cast(_place & 63 as int))").alias("_bit")
    used = place.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    every = used.sparkSession.range(0, BITS // 64, 1, 1).select(F.col("id").alias("_word")).join(used, "_word", "left")
    entry = F.struct("_word", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("_bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_bits"]).alias("bits")).scalar()


def _places(texts: DataFrame, anchors: DataFrame, carry: list[str]) -> DataFrame:
    """All places of the texts with the hash of what begins there: carry, _hash, _span, _at. Reads ``text``; only whole texts move."""
    spans = anchors.agg(F.collect_set("_span").alias("spans"))
    # Every text has many places, which adaptive execution cannot foresee when it merges small
    # partitions; a fixed number of partitions keeps the cutting parallel. (By a hash of the text, as
    # a repartitioning by the text itself would be dropped as done already.)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        texts.repartition(parts, F.xxhash64("text")).select(*carry, "text", spans.scalar().alias("_spans"))
        .select(*carry, "text", F.explode("_spans").alias("_span"))
        .where(F.length("text") >= F.col("_span"))
        .select(*carry, "text", "_span", F.explode(F.expr("sequence(1, length(text) - _span + 1)")).alias("_at"))
        .select(*carry, F.expr("xxhash64(substring(text, _at, _span))").alias("_hash"), "_span", "_at")
    )


def _cut_out(known: DataFrame, carry: list[str]) -> DataFrame:
    """Candidate strings (carry..., pattern) of the wanted lengths that fit at each place."""
    fitting = F.filter("_lengths", lambda n: F.col("_at") + n - 1 <= F.length("text"))
    return known.select(*dict.fromkeys([*carry, "text", "_at"]), F.explode(fitting).alias("_length")).select(
        *carry, F.expr("substring(text, _at, _length)").alias("pattern"))


def hits(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places of the texts (id, text) whose hash is in the bitmap: _hash, _span, id, _at."""
    place = F.col("_hash").bitwiseAND(F.lit(BITS - 1))
    word = F.get(_bitmap(anchors), F.shiftright(place, 6).cast("int"))
    found = _places(texts, anchors, ["id"]).where(F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found.select("_hash", "_span", "id", "_at")


def _known(found: DataFrame, anchors: DataFrame, salts: int | None) -> DataFrame:
    """Hits (stored) at known anchors: id, _at, _lengths. Hits of common hashes are dealt to several tasks by their measured number."""
    counted = found.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > TASK_HITS)
    enough = F.ceil(F.col("_n") / TASK_HITS).cast("int") if salts is None else F.lit(salts)
    common = counted.select("_hash", enough.alias("_salts"))
    if salts is not None:
        common = found.select("_hash").distinct().select("_hash", enough.alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    salted = anchors.join(common, "_hash", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    dealt = found.join(common, "_hash", "left").withColumn("_salt", F.pmod(F.xxhash64("id", "_at"), one).cast("int")).drop("_salts")
    return dealt.join(salted.hint("merge"), ["_hash", "_span", "_salt"]).select("id", "_at", "_lengths")


def _occurrences(texts: DataFrame, patterns: DataFrame, carry: list[str], small: bool, salts: int | None) -> DataFrame:
    """Rows (carry..., pattern) for every place where a text may hold a pattern. Reads ``text`` and ``pattern``."""
    anchors = _anchors(patterns)
    if small:
        # There is at most one anchor per pattern, and its row is no longer than a few patterns. The hash table itself is looked up
        # where the text is read.
        places = _places(texts, anchors, [*dict.fromkeys([*carry, "text"])])
        return _cut_out(places.join(F.broadcast(anchors), ["_hash", "_span"]), carry)
    anchors = stage(anchors, "anchors")
    kept = stage(texts.select(F.monotonically_increasing_id().alias("id"), *dict.fromkeys([*carry, "text"])), "texts")
    known = stage(_known(stage(hits(kept.select("id", "text"), anchors), "hits"), anchors, salts), "hits")
    return _cut_out(known.join(kept.hint("merge"), "id"), carry)


def first_text_with(texts: DataFrame, patterns: DataFrame, *, salts: int | None = None) -> DataFrame:
    """For each pattern the lowest ``rank`` of the texts that contain it: pattern, rank.

    ``texts`` has (text, rank), ``patterns`` distinct non-empty ``pattern`` values. Candidates are
    reduced to one row per string before they are shuffled. ``salts`` deals the hits of every anchor to so many tasks, whatever
    their number.
    """
    patterns, small = stage_measured(patterns.select("pattern"), "patterns")
    # Copies of a text are one text.
    texts = texts.where(F.length("text") > 0).groupBy("text").agg(F.min("rank").alias("rank"))
    lowest = _occurrences(texts, patterns, ["rank"], small, salts).groupBy("pattern").agg(F.min("rank").alias("rank"))
    return lowest.join(F.broadcast(patterns) if small else patterns.hint("merge"), "pattern", "left_semi")


def patterns_in(texts: DataFrame, patterns: DataFrame, *, salts: int | None = None) -> DataFrame:
    """Rows (text, pattern columns...) for the patterns each text contains, one per place it occurs.

    ``texts`` has distinct ``text`` values. A text holds at most as many patterns as it has
    substrings, whatever their number.
    """
    patterns, small = stage_measured(patterns, "patterns")
    texts = texts.select("text").where(F.length("text") > 0)
    found = _occurrences(texts, patterns, ["text"], small, salts)
    return found.join(F.broadcast(patterns) if small else patterns.hint("merge"), "pattern")
