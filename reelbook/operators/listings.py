"""Projections, filters and orders of the listing screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.operators.joins import lookup

# Fields shown per resource, and columns of the back-office lists.
PUBLIC_FIELDS = {
    "tournaments": ["pk", "name", "date", "place", "JTR", "tugeny_link", "color", "slug"],
    "teams": ["pk", "logo", "name", "slug"],
    "games": ["pk", "name", "source_name", "tournament", "rendered", "team1", "team2", "json_file", "source_proxy"],
    "cuts": ["pk", "name", "type_cut", "json_file", "game", "slug"],
    "team_logos": ["pk", "name", "short_name", "image"],
    "tmp_images": ["pk", "name", "image"],
    "video_metadata": [
        "pk", "name", "tournament", "time_code", "miniature_x_offset", "miniature_y_offset", "miniature_zoom",
        "base_image", "miniature_image", "team1", "team2", "video_name", "description", "publication_date",
    ],
    "yt_videos": ["pk", "title", "video_id", "linked_video", "publication_date", "privacy_status"],
}
ADMIN_COLUMNS = {
    "tournaments": ["name", "short_name", "place", "date", "JTR", "tugeny_link"],
    "games": ["name", "tournament", "team1", "team2", "rendered", "json_file"],
    "teams": ["name", "logo"],
    "video_metadata": ["name", "tournament", "team1", "team2", "publication_date", "time_code"],
    "tmp_images": ["name", "image"],
    "yt_videos": ["title", "video_id", "publication_date"],
}
#: Relations listed per parent: (table, foreign key, order).
CHILDREN = {
    "teams_of_logo": ("teams", "logo", "name"),
    "games_of_tournament": ("games", "tournament", "name"),
    "videos_of_tournament": ("video_metadata", "tournament", "name"),
    "cuts_of_game": ("cuts", "game", "name"),
    "online_videos_of_video": ("yt_videos", "linked_video", "pk"),
}


def project(table: DataFrame, entity: str) -> DataFrame:
    """Public fields of a table."""
    return table.select(PUBLIC_FIELDS[entity])


def admin_list(tables: dict[str, DataFrame], entity: str) -> DataFrame:
    """Back-office list with the referenced rows shown by name; online videos come newest first."""
    df = tables[entity]
    for fk, target, _ in C.FOREIGN_KEYS.get(entity, []):
        if fk in ADMIN_COLUMNS[entity]:
            df = lookup(df, tables[target], fk, {"_shown": "name"}).withColumn(fk, F.col("_shown")).drop("_shown")
    if entity == "yt_videos":
        df = recent_online_videos(df)
    return df.select(ADMIN_COLUMNS[entity])


def by_foreign_key(table: DataFrame, fk: str, order: str = "name", *, value: int | None = None) -> DataFrame:
    """Child rows of one parent in order, or of all parents, sorted by parent first.

    The sort ranges over (parent, order, pk), so a parent of any size spreads over many tasks.
    """
    if value is not None:
        return table.where(F.col(fk) == value).orderBy(order, "pk")
    return table.where(F.col(fk).isNotNull()).orderBy(*dict.fromkeys([fk, order, "pk"]))


def filter_by_tournament(table: DataFrame, tournament: int) -> DataFrame:
    """Rows of one tournament; a snapshot laid out by tournament reads only its folder."""
    return table.where(F.col("tournament") == tournament)


def expired_images(images: DataFrame, as_of: Column, *, start: str = C.RETENTION_START) -> DataFrame:
    """Images dated from the start of retention to ``as_of``, both days included."""
    return images.where(F.col("date").between(F.lit(start).cast("date"), as_of.cast("date")))


def order_by_name(table: DataFrame) -> DataFrame:
    """Rows by name, then pk."""
    return table.orderBy("name", "pk")


def recent_online_videos(yt_videos: DataFrame, n: int | None = None) -> DataFrame:
    """Online videos newest first, or the newest ``n`` of them."""
    ordered = yt_videos.orderBy(F.desc("publication_date"), "pk")
    return ordered if n is None else limit_n(ordered, n)


def limit_n(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered table."""
    return ordered.limit(n)
