"""Counts and per-video aggregates of the listing screens. All combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.functions import text as X


def videos_per_tournament(tournaments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Number of recordings per tournament, 0 included: pk, name, n_videos."""
    counts = recordings.where(F.col("tournament").isNotNull()).groupBy("tournament").agg(F.count("*").alias("n"))
    joined = tournaments.join(counts, tournaments["pk"] == counts["tournament"], "left")
    return joined.select("pk", "name", F.coalesce("n", F.lit(0)).alias("n_videos"))


def tournament_count(tournaments: DataFrame) -> DataFrame:
    """Number of tournaments."""
    return tournaments.agg(F.count("*").alias("n_tournaments"))


def publish_status_per_video(yt_videos: DataFrame, as_of: Column) -> DataFrame:
    """Publication state per linked recording; of several online videos the last one counts: video, status."""
    coded = yt_videos.where(F.col("linked_video").isNotNull()).select(
        F.col("linked_video").alias("video"), "pk", X.status_code("privacy_status", "publication_date", as_of).alias("_code")
    )
    # Two numbers per group keep this a hash aggregate; the label is put on afterwards.
    last = coded.groupBy("video").agg(F.max_by("_code", "pk").alias("_code"))
    return last.select("video", X.label_of("_code").alias("status"))


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number; a null in a key never violates."""
    complete = table.dropna(subset=keys)
    return complete.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def team_index(choices: DataFrame, *, order: str = "name") -> DataFrame:
    """One team choice per URL: of several the last by ``order``."""
    others = [c for c in choices.columns if c != "url"]
    last = choices.groupBy("url").agg(F.max_by(F.struct(*others), order).alias("_last"))
    return last.select(*["url" if c == "url" else F.col(f"_last.{c}").alias(c) for c in choices.columns])
