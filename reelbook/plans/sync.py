"""Folder sync and catalogue sync as whole jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.operators.changes import create_recordings, upsert_catalogue
from reelbook.operators.joins import new_recordings
from reelbook.operators.linking import link_exact, relink_apply
from reelbook.operators.links import apply_links, with_recordings
from reelbook.operators.listings import order_by_name
from reelbook.session import stage
from reelbook.sources.files import list_video_files


@dataclass(frozen=True)
class FolderSync:
    """Tables after a folder sync and the rows it made."""

    recordings: DataFrame
    created: DataFrame
    relink: Callable[[DataFrame], DataFrame]

    def relink_kept(self, yt_videos: DataFrame, links: DataFrame, *, scope: str = "all") -> tuple[DataFrame, DataFrame]:
        """The online videos linked again, and the table of links as it is afterwards.

        ``links`` holds for the titles of the online videos what the recordings before the sync gave (see
        :mod:`reelbook.operators.links`); only names of recordings made by the sync are read.
        """
        after = stage(with_recordings(links, self.created), "title-links")
        return apply_links(yt_videos, after, scope=scope), after

    def listing(self) -> DataFrame:
        """The recordings in name order."""
        return order_by_name(self.recordings)


def sync_recordings(files: DataFrame, recordings: DataFrame, tournaments: DataFrame, team_logos: DataFrame,
                    probes: DataFrame, as_of: Column, *, tournament: int | None = None, scope: str = "all") -> FolderSync:
    """Make recordings of new files (name, tournament); ``relink`` then gives the online videos linked again.

    ``tournament`` syncs one tournament; without it all are synced and all recordings are candidates.
    """
    if tournament is not None:
        files = files.where(F.col("tournament") == tournament)
    fresh = new_recordings(list_video_files(files).select("name", "tournament"), recordings)
    created = create_recordings(fresh, recordings, tournaments, team_logos, probes, as_of)
    table = recordings.unionByName(created)
    return FolderSync(
        table, created, lambda yt_videos: relink_apply(yt_videos, table, tournament=tournament, scope=scope)
    )


def sync_catalogue(yt_videos: DataFrame, items: DataFrame, recordings: DataFrame | None = None,
                   tournament: int | None = None, *, update_on: str = "title") -> DataFrame:
    """The online videos after a catalogue sync, with unlinked ones linked by exact title on request."""
    table = upsert_catalogue(yt_videos, items, update_on=update_on)
    return table if recordings is None else link_exact(table, recordings, tournament)
