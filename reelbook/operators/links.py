"""Which recording each title links to, kept as a table while recordings and titles come and go.

The table has a row per lower-case title of the online videos: ``pattern`` and ``recording``, the lowest pk whose name or title contains it,
null where there is none. Linking all videos anew compares all titles with all names; kept up to date, a sync compares the titles with the
names of its new recordings only, a catalogue sync its new titles with all names, and a deletion the titles it leaves without link.
Each function returns the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.operators.substring import first_text_with
from reelbook.session import stage


def _texts(recordings: DataFrame) -> DataFrame:
    """Names and titles of recordings: text, rank."""
    return recordings.select(F.col("pk").alias("rank"), F.explode(F.array(F.lower("name"), F.lower("video_name"))).alias("text"))


def _found(patterns: DataFrame, recordings: DataFrame) -> DataFrame:
    """Patterns with the lowest of the given recordings that contains each: pattern, recording. An empty one is part of every name."""
    hit = stage(first_text_with(_texts(recordings), patterns.where(F.length("pattern") > 0)), "links")
    named = recordings.where(F.col("name").isNotNull() | F.col("video_name").isNotNull())
    anything = named.agg(F.min("pk").alias("pk")).scalar()
    joined = patterns.select("pattern").join(hit, "pattern", "left")
    return joined.select("pattern", F.when(F.col("pattern") == "", anything).otherwise(F.col("rank")).alias("recording"))


def _patterns(yt_videos: DataFrame) -> DataFrame:
    return yt_videos.select(F.lower("title").alias("pattern")).where(F.col("pattern").isNotNull()).distinct()


def title_links(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """The table made from scratch."""
    return _found(_patterns(yt_videos), recordings)


def with_recordings(links: DataFrame, created: DataFrame) -> DataFrame:
    """After recordings were added: a title links to a new one where that is its first, or has the lower pk. Reads new names only."""
    new = _found(links.select("pattern"), created).withColumnRenamed("recording", "_new")
    return links.join(new, "pattern", "left").select("pattern", F.least("recording", "_new").alias("recording"))


def with_titles(links: DataFrame, yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """After titles were added or changed: those not in the table are looked up among all recordings. Rows of unused titles stay."""
    fresh = stage(_patterns(yt_videos).join(links.select("pattern"), "pattern", "left_anti"), "titles")
    return links.select("pattern", "recording").unionByName(_found(fresh, recordings))


def without_recordings(links: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """After recordings (``gone``: pk) were deleted: titles that linked to one are looked up among those ``left``."""
    keys = gone.select(F.col("pk").alias("recording")).distinct()
    lost = stage(links.join(keys, "recording", "left_semi").select("pattern"), "titles")
    kept = links.join(keys, "recording", "left_anti").select("pattern", "recording")
    return kept.unionByName(_found(lost, left))


def with_renamed(links: DataFrame, renamed: DataFrame, recordings: DataFrame) -> DataFrame:
    """After recordings got other names or titles (``renamed``: their rows as they are now, also part of ``recordings``)."""
    return with_recordings(without_recordings(links, renamed, recordings), renamed)


def without_titles(links: DataFrame, yt_videos: DataFrame) -> DataFrame:
    """Rows of titles some online video has."""
    return links.join(_patterns(yt_videos), "pattern", "left_semi").select("pattern", "recording")


def apply_links(yt_videos: DataFrame, links: DataFrame, *, scope: str = "all") -> DataFrame:
    """The online videos with ``linked_video`` from the table; ``scope='matched'`` keeps the link of a video whose title has none."""
    if scope not in ("all", "matched"):
        raise ValueError("scope is 'all' or 'matched'")
    side = links.select(F.col("pattern").alias("_pattern"), F.col("recording").alias("_new"))
    new = F.col("_new") if scope == "all" else F.coalesce("_new", "linked_video")
    joined = yt_videos.withColumn("_pattern", F.lower("title")).join(side, "_pattern", "left")
    return joined.select(*[new.alias(c) if c == "linked_video" else F.col(c) for c in yt_videos.columns])
