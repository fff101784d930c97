"""Joins along foreign keys.

No join here carries a broadcast hint. A side is broadcast when Spark has measured it (file or
shuffle-stage statistics) as below the session threshold; otherwise the join sorts and merges, and
adaptive execution splits a key that holds too many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, dim: DataFrame, fk: str, columns: Mapping[str, str], *, key: str = "pk") -> DataFrame:
    """Add columns of the row a nullable foreign key points to; ``columns`` maps new name to column of ``dim``."""
    side = dim.select(F.col(key).alias("_key"), *[F.col(c).alias(new) for new, c in columns.items()])
    return facts.join(side, F.col(fk) == F.col("_key"), "left").drop("_key")


def existing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in ``others``.

    Keys are made distinct first: copies fall away before the shuffle, which the join needs anyway.
    """
    return rows.join(others.select(keys).distinct(), keys, "left_semi").select(rows.columns)


def missing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``others``."""
    return rows.join(others.select(keys).distinct(), keys, "left_anti").select(rows.columns)


def recording_details(recordings: DataFrame, tournaments: DataFrame, team_logos: DataFrame, tmp_images: DataFrame, *,
                      team_columns: Sequence[str] = (), tournament_columns: Sequence[str] = ()) -> DataFrame:
    """Recordings with the fields of their tournament, team logos and images that views need.

    Further columns of a team or tournament come under its prefix (``team1_``, ``tournament_``).
    """
    df = lookup(recordings, tournaments, "tournament", {
        "tournament_name": "name", "tournament_slug": "slug", "tournament_color": "color", "tournament_date": "date",
        "tournament_dir": "source_dir", "tournament_tugeny_link": "tugeny_link", "tournament_JTR": "JTR",
    } | {f"tournament_{c}": c for c in tournament_columns})
    for team in ("team1", "team2"):
        df = lookup(df, team_logos, team, {f"{team}_{c}": c for c in ("name", "image", *team_columns)})
    df = lookup(df, tmp_images, "base_image", {"base_image_name": "name", "base_image_path": "image"})
    return lookup(df, tmp_images, "miniature_image", {"miniature_name": "name", "miniature_path": "image"})


def new_recordings(files: DataFrame, recordings: DataFrame) -> DataFrame:
    """Listed files (name, tournament) without a recording."""
    return missing(files, recordings, ["name", "tournament"])


def new_games(grouped: DataFrame, games: DataFrame) -> DataFrame:
    """Grouped recordings whose stored source name is not among the games."""
    return missing(grouped, games, ["source_name"])


def has_linked_video(recordings: DataFrame, yt_videos: DataFrame, *, linked: bool = True) -> DataFrame:
    """Recordings with (or without) an online video."""
    keys = yt_videos.select(F.col("linked_video").alias("pk"))
    return existing(recordings, keys, ["pk"]) if linked else missing(recordings, keys, ["pk"])


def resolve_entity_url(rows: DataFrame, url: str, target: DataFrame, entity: str, *, alias: str) -> DataFrame:
    """Add ``alias``, the pk of the ``entity`` row that a URL names; null when there is none."""
    path = F.try_parse_url(F.col(url), F.lit("PATH"))
    pattern = r"/([a-z_]+)/(\d+)/?$"
    pk = F.regexp_extract(path, pattern, 2).try_cast("bigint")
    keyed = rows.withColumn("_pk", F.when(F.regexp_extract(path, pattern, 1) == entity, pk))
    return lookup(keyed, target, "_pk", {alias: "pk"}).drop("_pk")
