"""Which two teams a file name mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbook.operators.numbering import top_rows
from reelbook.operators.substring import patterns_in


def default_team(team_logos: DataFrame) -> DataFrame:
    """The one-row fallback: the logo with the lowest pk."""
    return team_logos.agg(F.min("pk").alias("default_team"))


def order_by_abbreviation_length(team_logos: DataFrame) -> DataFrame:
    """Logos, shortest abbreviation first."""
    return team_logos.orderBy(F.length("short_name"), "pk")


def _wanted(team_logos: DataFrame) -> DataFrame:
    """Names and abbreviations with their two preferred logos; more can never be among a file's two."""
    spelled = team_logos.select(
        "pk",
        F.length("short_name").alias("size"),
        F.explode(F.array_distinct(F.array(F.lower("short_name"), F.lower("name")))).alias("pattern"),
    ).where(F.col("pattern").isNotNull())
    return top_rows(spelled, ["pattern"], ["size", "pk"], 2).drop("rank")


def _best_two(files: DataFrame, team_logos: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """Distinct lower-case file names that mention a logo, with their first two: text, found (size, pk) in order; and a column
    of the first two for any name, given its ``found``."""
    texts = files.select(F.lower(name).alias("text")).where(F.col("text").isNotNull()).distinct()
    wanted = _wanted(team_logos)
    matches = patterns_in(texts, wanted.where(F.length("pattern") > 0))
    logo = F.struct("size", "pk")

    def first_two(logos: Column) -> Column:
        return F.slice(F.sort_array(logos), 1, 2)

    # A logo found twice, by both spellings or in two places, counts once. A name mentions two logos for each of its substrings at most.
    best = matches.groupBy("text").agg(first_two(F.collect_set(logo)).alias("found"))
    # An empty name or abbreviation is part of every file name; at most two of their logos count.
    empty = team_logos.where((F.col("short_name") == "") | (F.col("name") == "")).select(F.length("short_name").alias("size"), "pk")
    always = empty.orderBy("size", "pk").limit(2).agg(F.collect_set(logo)).scalar()
    none = F.array().cast("array<struct<size:int,pk:bigint>>")
    return best, first_two(F.array_distinct(F.concat(F.coalesce("found", none), F.coalesce(always, none))))


def top2_matches(files: DataFrame, team_logos: DataFrame, *, name: str = "name") -> DataFrame:
    """The first two logos per distinct lower-case file name: text, rank, logo.

    Matches are ordered by length of the abbreviation, then pk.
    """
    best, logos = _best_two(files, team_logos, name)
    texts = files.select(F.lower(name).alias("text")).where(F.col("text").isNotNull()).distinct()
    rows = texts.join(best, "text", "left").select("text", F.posexplode(logos).alias("_pos", "_logo"))
    return rows.select("text", (F.col("_pos") + 1).cast("bigint").alias("rank"), F.col("_logo.pk").alias("logo"))


def identify_teams(files: DataFrame, team_logos: DataFrame, *, name: str = "name") -> DataFrame:
    """Files with ``team1`` and ``team2`` (logo keys).

    No match: both are the default. One: it comes first. More: the shortest abbreviation comes second.
    """
    best, logos = _best_two(files, team_logos, name)
    kept = [c for c in files.columns if c not in ("team1", "team2")]
    # A null name mentions nobody, not even a logo with an empty name.
    matched = files.select(*kept, F.lower(name).alias("_text")).join(best.withColumnRenamed("text", "_text"), "_text", "left")
    mentioned = matched.select(*kept, F.when(F.col("_text").isNotNull(), logos).alias("_logos"), default_team(team_logos).scalar().alias("_default"))
    entries = defaults_then_matches(F.col("_default"), F.coalesce("_logos.pk", F.array().cast("array<bigint>")))
    return mentioned.select(*kept, F.element_at(entries, -1).alias("team1"), F.element_at(entries, -2).alias("team2"))


def defaults_then_matches(default: Column, matches: Column) -> Column:
    """The default, twice, followed by the matches there are."""
    return F.concat(F.array(default, default), matches)
