"""The two listing screens as one query each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.operators.counts import publish_status_per_video, videos_per_tournament
from reelbook.operators.joins import lookup


def tournament_games_view(recordings: DataFrame, team_logos: DataFrame, tmp_images: DataFrame, yt_videos: DataFrame,
                          as_of: Column) -> DataFrame:
    """A row per recording: pk, tournament, miniature, name, teams, status, description."""
    df = lookup(recordings, team_logos, "team1", {"_team1": "name"})
    df = lookup(df, team_logos, "team2", {"_team2": "name"})
    df = lookup(df, tmp_images, "miniature_image", {"miniature": "image"})
    df = lookup(df, publish_status_per_video(yt_videos, as_of), "pk", {"status": "status"}, key="video")

    def shown(c: str) -> Column:
        return F.coalesce(c, F.lit(""))

    return df.select(
        "pk", "tournament", "miniature", "name", F.concat(shown("_team1"), F.lit(" vs "), shown("_team2")).alias("teams"),
        "status", "description",
    )


def tournaments_view(tournaments: DataFrame, recordings: DataFrame) -> DataFrame:
    """A row per tournament: pk, color, name, date, n_videos."""
    counts = videos_per_tournament(tournaments, recordings).select("pk", "n_videos")
    return tournaments.join(counts, "pk").select("pk", "color", "name", "date", "n_videos")
