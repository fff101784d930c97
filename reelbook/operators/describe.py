"""Chapters, descriptions and split recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.functions import text as X
from reelbook.operators.numbering import number_within


def number_chapters(chapters: DataFrame, *, group: str = "video", start: str = "start_time") -> DataFrame:
    """Chapters of a table numbered from 1 in time order within each recording.

    Slices of the chapters by measured ranges keep the work even when one recording has most of them, at whatever times.
    Chapters whose start is no number come first.
    """
    timed = chapters.withColumn("_seconds", F.col(start).try_cast("double"))
    return number_within(timed, [group], "_seconds", ties=[start]).drop("_seconds")


def chapter_probes(chapters: DataFrame, *, group: str = "video") -> DataFrame:
    """Chapters of a table back in probe form, an array in time order per recording.

    An array becomes one description text (see :func:`description_lines` for recordings with more chapters than one text
    should hold). Equal chapters are all kept, as each has a number of its own.
    """
    entry = F.struct(F.col("start_time").cast("double").alias("_at"), "start_time", "end_time")
    ordered = F.sort_array(F.collect_list(entry))
    bare = F.transform(ordered, lambda c: F.struct(c["start_time"].alias("start_time"), c["end_time"].alias("end_time")))
    return chapters.groupBy(group).agg(bare.alias("chapters"))


def unreadable_chapters(chapters: DataFrame, *, start: str = "start_time") -> DataFrame:
    """Chapters whose start is no number: they have a position but no line in a description. To be mended before describing."""
    return chapters.where(F.expr(f"try_cast(`{start}` as double)").isNull())


def _header(team1: str, team2: str) -> list[Column]:
    """The lines above the chapters."""
    return [
        F.concat(F.col(team1), F.lit(" vs "), F.col(team2)),
        F.lit(C.REFEREE_LINE),
        F.coalesce(F.col("tournament_date").cast("string"), F.lit("")),
        F.lit(""),
        F.coalesce("tournament_tugeny_link", F.lit("")),
        F.coalesce("tournament_JTR", F.lit("")),
        F.lit(""),
    ]


def description_text(chapters: Column, *, team1: str = "team1_name", team2: str = "team2_name") -> Column:
    """Description of a recording with its details and chapter array in the row; needs no shuffle."""
    points = F.transform(chapters, lambda c, i: X.chapter_line(c["start_time"], i + 1))
    lines = F.concat(F.array(*_header(team1, team2)), F.coalesce(points, F.array().cast("array<string>")))
    return F.array_join(lines, "\n")


def description_lines(details: DataFrame, chapters: DataFrame) -> DataFrame:
    """Descriptions line by line: pk, line_no from 1, line.

    ``chapters`` is the table (video, start_time, ...). No recording is gathered in one place, so one
    with any number of chapters can be described; joined by newlines the lines give the text form.
    """
    header = _header("team1_name", "team2_name")
    top = details.select("pk", F.posexplode(F.array(*header)).alias("_pos", "line")).select(
        "pk", (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line"
    )
    points = number_chapters(chapters).join(details.select(F.col("pk").alias("video")), "video")
    return top.unionByName(points.select(
        F.col("video").alias("pk"), (F.col("position") + len(header)).alias("line_no"), X.chapter_line("start_time", "position").alias("line")
    ))


def description_parts(details: DataFrame, chapters: DataFrame, *, size: int = 1000) -> DataFrame:
    """Descriptions in parts of ``size`` lines: pk, part from 0, n_lines, unreadable, text.

    The texts of a recording's parts in order, joined by newlines, are its description. ``unreadable`` counts the chapters of a part whose
    start is no number: they have a position but no line in the text. No task gathers more than ``size`` lines of a recording.
    """
    part = F.floor((F.col("line_no") - 1) / F.lit(size)).cast("bigint").alias("part")
    lines = description_lines(details, chapters).select("pk", part, "line_no", "line")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("pk", "part").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("line").isNull(), 1)).alias("unreadable"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"),
    )


def metadata_public_view(details: DataFrame) -> DataFrame:
    """Public metadata of recordings with both teams: pk, vid_name (null without tournament), description, pub_date."""
    return details.where(F.col("team1_name").isNotNull() & F.col("team2_name").isNotNull()).select(
        "pk",
        F.when(F.col("tournament_name").isNotNull(), X.video_title("team1_name", "team2_name", "tournament_name")).alias(
            "vid_name"
        ),
        "description",
        X.format_pub_date("publication_date").alias("pub_date"),
    )


def group_recording_parts(parts: DataFrame, *, folder: str = "dir") -> DataFrame:
    """Parts of each split recording: folder, key, parts in order, rebuilt file names.

    Part numbers have two digits, so an array has at most 100 entries.
    """
    grouped = parts.groupBy(folder, "key").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    return grouped.select("*", F.transform("parts", lambda p: X.part_file_name(p, F.col("key"))).alias("files"))


def require_teams_and_tournament(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings a title and description can be derived for, and the others."""
    complete = (
        F.col("tournament_name").isNotNull() & F.col("team1_name").isNotNull() & F.col("team2_name").isNotNull()
    )
    return details.where(complete), details.where(~complete)
