"""All recordings claim their online video, one after the other, as a set-based job.

Called in pk order, each recording takes the first free video under either of its two titles. Within a title the n-th recording to take
one there gets its n-th video, so all that has to be found is which of its titles a recording turns to. A recording with one title
that has free videos has no choice. One with two turns to the title whose next video is lower, and how far a title is used up by
then depends on the recordings before it: at least by those known to turn there, at most by the undecided ones as well. Where
these bounds settle the choice it is settled, for all recordings at once; then the bounds are taken anew. A title that many recordings
share costs no further round, as it is counted, not walked through. What the bounds leave, recordings that hang on each other's
choices in a chain, is walked through in pk order, a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook.functions.text import stem
from reelbook.operators.numbering import sums_before
from reelbook.session import stage

#: Undecided recordings one task walks through.
WALKED = 100_000
#: A round that settles a smaller part of the undecided recordings is followed by a walk.
SETTLED_SHARE = 0.25


def _choices(recordings: DataFrame, free: DataFrame) -> DataFrame:
    """Recordings with their titles that have free videos: recording, a, b; b is null where there is one. Others are left out."""
    titles = free.select("title").distinct()
    keys = recordings.select(
        F.col("pk").alias("recording"), F.coalesce(stem("name"), F.lit("")).alias("_a"), F.coalesce("video_name", F.lit("")).alias("_b")
    )
    found = keys.join(titles.withColumnRenamed("title", "_a").withColumn("_has_a", F.lit(True)), "_a", "left")
    found = found.join(titles.withColumnRenamed("title", "_b").withColumn("_has_b", F.lit(True)), "_b", "left")
    a, b = F.when(F.col("_has_a"), F.col("_a")), F.when(F.col("_has_b") & (F.col("_a") != F.col("_b")), F.col("_b"))
    return found.select("recording", F.coalesce(a, b).alias("a"), F.when(a.isNotNull(), b).alias("b")).where(F.col("a").isNotNull())


def _at(rows: DataFrame, queue: DataFrame, title: str, place: str, alias: str) -> DataFrame:
    """``rows`` with the free video of a title at a place, null behind the last."""
    side = queue.select(F.col("title").alias(title), F.col("place").alias(place), F.col("yt_video").alias(alias))
    return rows.join(side, [title, place], "left")


def _bounds(settled: DataFrame, open_: DataFrame, queue: DataFrame) -> DataFrame:
    """Undecided recordings with the first and last place they can be given in each title, and the videos there.

    ``low`` places count the recordings before that are known to turn to the title, ``high`` places the undecided ones too.
    """
    rows = open_.select("recording", F.explode(F.array("a", "b")).alias("title")).withColumn("_sure", F.lit(0))
    touched = rows.select("title").distinct()
    sure = settled.join(touched, "title", "left_semi").select("recording", "title").withColumn("_sure", F.lit(1))
    counted = sums_before(rows.unionByName(sure), ["title"], ["recording"], {"low": F.col("_sure"), "high": F.lit(1)}, "claim-places")
    counted = counted.where(F.col("_sure") == 0).select("recording", "title", "low", "high")
    both = open_
    for t in ("a", "b"):
        side = counted.select("recording", F.col("title").alias(t), F.col("low").alias(f"low_{t}"), F.col("high").alias(f"high_{t}"))
        both = both.join(side, ["recording", t])
    for t in ("a", "b"):
        both = _at(_at(both, queue, t, f"low_{t}", f"first_{t}"), queue, t, f"high_{t}", f"last_{t}")
    return both


def _turn() -> Column:
    """The title a recording turns to whatever the undecided ones before it do, or null.

    A title used up by those known to turn there leaves only the other one. Recordings with nothing left count for title a, where
    they take nothing from later ones.
    """
    first_a, first_b, last_a, last_b = (F.col(c) for c in ("first_a", "first_b", "last_a", "last_b"))
    return (
        F.when(first_b.isNull(), F.col("a")).when(first_a.isNull(), F.col("b"))
        .when(last_a < first_b, F.col("a")).when(last_b < first_a, F.col("b"))
    )


def _walk(bounds: DataFrame, queue: DataFrame) -> DataFrame:
    """The first ``WALKED`` undecided recordings decided in pk order: recording, title.

    All before the first are settled, so places are exact: the low place plus those walked through that turned to the title.
    Only the stretch of each queue they can reach is read.
    """
    chosen = stage(bounds.orderBy("recording").limit(WALKED).select("recording", "a", "b", "low_a", "low_b", "high_a", "high_b"), "claim-walk")
    ends = [chosen.select(F.col(t).alias("title"), F.col(f"low_{t}").alias("low"), F.col(f"high_{t}").alias("high")) for t in ("a", "b")]
    reach = ends[0].unionByName(ends[1]).groupBy("title").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    videos = queue.join(reach, "title").where(F.col("place").between(F.col("low"), F.col("high"))).select("title", "place", "yt_video")

    def walk(members: pd.DataFrame, stretch: pd.DataFrame) -> pd.DataFrame:
        at = {(t, p): v for t, p, v in zip(stretch["title"], stretch["place"], stretch["yt_video"])}
        turned: dict[str, int] = {}
        out = []
        for r, a, b, low_a, low_b in members.sort_values("recording")[["recording", "a", "b", "low_a", "low_b"]].itertuples(index=False):
            in_a, in_b = at.get((a, low_a + turned.get(a, 0))), at.get((b, low_b + turned.get(b, 0)))
            title = b if in_a is None or (in_b is not None and in_b < in_a) else a
            turned[title] = turned.get(title, 0) + 1
            out.append((r, title))
        return pd.DataFrame(out, columns=["recording", "title"])

    one = F.lit(0).alias("_task")
    return chosen.groupBy(one).cogroup(videos.groupBy(one)).applyInPandas(walk, "recording bigint, title string")


def _rounds(choices: DataFrame, queue: DataFrame) -> Iterator[DataFrame]:
    """Recordings with the title they turn to, in stored parts that together hold all of them."""
    one = F.col("b").isNull()
    settled = choices.where(one).select("recording", F.col("a").alias("title"))
    yield settled
    open_ = choices.where(~one)
    left = open_.count()
    while left:
        bounds = stage(_bounds(settled, open_, queue).withColumn("turn", _turn()), "claim-bounds")
        found = bounds.where(F.col("turn").isNotNull()).select("recording", F.col("turn").alias("title"))
        open_ = bounds.where(F.col("turn").isNull())
        still = open_.count()
        if still and (still <= WALKED or still > (1 - SETTLED_SHARE) * left):
            # The first undecided recording has only settled ones before it, those of this round included.
            known = settled.unionByName(found)
            found = stage(found.unionByName(_walk(_bounds(known, open_.select("recording", "a", "b"), queue), queue)), "claim-turns")
            open_ = open_.join(found.select("recording"), "recording", "left_anti")
            still = max(0, still - WALKED)
        open_ = open_.select("recording", "a", "b")
        settled, left = settled.unionByName(found), still
        yield found


def claims(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """What every recording gets when all claim in pk order: recording, yt_video. Those that get nothing are left out.

    Equal to asking for each recording in turn, with the links made so far in place. An empty title is a title like others; a
    null name or title counts as empty on the side of the recordings and matches nothing on the side of the videos. Keys
    of both tables are unique.
    """
    free = yt_videos.where(F.col("linked_video").isNull() & F.col("title").isNotNull()).select("title", F.col("pk").alias("yt_video"))
    choices = stage(_choices(recordings, free), "claim-titles")
    # Only titles some recording asks for are queues.
    asked = choices.select(F.explode(F.array_compact(F.array("a", "b"))).alias("title")).distinct()
    wanted = free.join(asked, "title", "left_semi")
    queue = stage(sums_before(wanted, ["title"], ["yt_video"], {"place": F.lit(1)}, "claim-videos"), "claim-queue")
    turns = None
    for part in _rounds(choices, queue):
        turns = part if turns is None else turns.unionByName(part)
    placed = sums_before(turns, ["title"], ["recording"], {"place": F.lit(1)}, "claim-turns")
    return placed.join(queue, ["title", "place"]).select("recording", "yt_video")


def claim_all(yt_videos: DataFrame, recordings: DataFrame) -> DataFrame:
    """The online videos after all recordings have claimed theirs in pk order."""
    won = claims(yt_videos, recordings).select(F.col("yt_video").alias("pk"), F.col("recording").alias("_claimed"))
    link = F.coalesce("linked_video", "_claimed").alias("linked_video")
    return yt_videos.join(won, "pk", "left").select(*[link if c == "linked_video" else c for c in yt_videos.columns])
