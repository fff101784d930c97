"""Which recording an online video belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.functions.text import stem
from reelbook.operators.joins import existing
from reelbook.operators.substring import first_text_with
from reelbook.session import stage


def relink_videos(yt_videos: DataFrame, recordings: DataFrame, *, tournament: int | None = None,
                  latest: bool = False) -> DataFrame:
    """For every online video the recording whose name or title contains its title: pk, linked_video.

    Case does not matter; an empty title is part of every name. Several recordings: the lowest pk,
    or with ``latest`` the one published last, those without date behind. ``tournament`` limits the recordings only.
    """
    if tournament is not None:
        recordings = recordings.where(F.col("tournament") == tournament)
    pk = F.col("pk")
    age = -F.unix_micros(F.col("publication_date").cast("timestamp"))
    rank = F.struct(age.isNull().alias("undated"), age.alias("age"), pk) if latest else pk
    ranked = recordings.select(rank.alias("rank"), F.array(F.lower("name"), F.lower("video_name")).alias("texts"))
    texts = ranked.select("rank", F.explode("texts").alias("text"))
    titles = yt_videos.select("pk", F.lower("title").alias("pattern"))
    patterns = titles.select("pattern").where(F.length("pattern") > 0).distinct()
    # One row per linked title, made once; Spark then knows its size.
    found = stage(first_text_with(texts, patterns), "links")
    anything = ranked.agg(F.min("rank").alias("rank"))
    linked = titles.join(found, "pattern", "left").withColumn("_any", anything.scalar())
    best = F.when(F.col("pattern") == "", F.col("_any")).otherwise(F.col("rank"))
    return linked.select("pk", (best.getField("pk") if latest else best).alias("linked_video"))


def relink_apply(yt_videos: DataFrame, recordings: DataFrame, *, scope: str = "all", **options) -> DataFrame:
    """The online videos with ``linked_video`` overwritten.

    ``scope='all'`` clears the link of a video without a match; ``'matched'`` keeps it.
    """
    if scope not in ("all", "matched"):
        raise ValueError("scope is 'all' or 'matched'")
    links = relink_videos(yt_videos, recordings, **options).withColumnRenamed("linked_video", "_new")
    new = F.col("_new") if scope == "all" else F.coalesce("_new", "linked_video")
    return yt_videos.join(links, "pk").select(*[new.alias(c) if c == "linked_video" else c for c in yt_videos.columns])


def union_candidates(recordings: DataFrame, tournament: int) -> DataFrame:
    """Titles that name a recording exactly: title, pk. File names count for one tournament only."""
    names = recordings.where(F.col("tournament") == tournament).select(F.col("name").alias("title"), "pk")
    titles = recordings.select(F.col("video_name").alias("title"), "pk")
    return names.unionByName(titles).distinct()


def first_match(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: the lowest value."""
    return candidates.groupBy(key).agg(F.min(value).alias(value))


def title_match_exact(yt_videos: DataFrame, recordings: DataFrame, tournament: int) -> DataFrame:
    """Online videos whose title names some recording exactly."""
    return existing(yt_videos, union_candidates(recordings, tournament), ["title"])


def link_exact(yt_videos: DataFrame, recordings: DataFrame, tournament: int) -> DataFrame:
    """The online videos, unlinked ones linked to the first recording their title names exactly."""
    first = first_match(union_candidates(recordings, tournament), "title", "pk").withColumnRenamed("pk", "_candidate")
    link = F.coalesce("linked_video", "_candidate").alias("linked_video")
    return yt_videos.join(first, "title", "left").select(*[link if c == "linked_video" else c for c in yt_videos.columns])


def _claim_keys(recordings: DataFrame) -> DataFrame:
    """The two titles a recording answers to."""
    return recordings.select(
        "pk", F.coalesce(stem("name"), F.lit("")).alias("stem"), F.coalesce("video_name", F.lit("")).alias("video_name")
    )


def unlinked_candidates(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """Unlinked online videos that some recording could claim."""
    keys = _claim_keys(recordings).select(F.explode(F.array("stem", "video_name")).alias("title"))
    return existing(yt_videos.where(F.col("linked_video").isNull()), keys, ["title"])


def link_unlinked(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """What each recording would claim, the first unlinked video by either title: recording, yt_video."""
    free = first_match(
        yt_videos.where(F.col("linked_video").isNull()).select("title", F.col("pk").alias("yt_video")), "title", "yt_video"
    )
    keys = _claim_keys(recordings)
    by_stem = free.select(F.col("title").alias("stem"), F.col("yt_video").alias("_by_stem"))
    by_title = free.select(F.col("title").alias("video_name"), F.col("yt_video").alias("_by_title"))
    claims = keys.join(by_stem, "stem", "left").join(by_title, "video_name", "left")
    return claims.select(F.col("pk").alias("recording"), F.least("_by_stem", "_by_title").alias("yt_video")).where(
        F.col("yt_video").isNotNull()
    )


def claim_unlinked(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """The online videos after one round of claims; the lowest recording pk wins a contested video."""
    winners = first_match(link_unlinked(yt_videos, recordings), "yt_video", "recording").select(
        F.col("yt_video").alias("pk"), F.col("recording").alias("_claimed")
    )
    link = F.coalesce("linked_video", "_claimed").alias("linked_video")
    return yt_videos.join(winners, "pk", "left").select(*[link if c == "linked_video" else c for c in yt_videos.columns])
