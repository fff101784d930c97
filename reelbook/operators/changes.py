"""Table changes. Each returns the table as it is afterwards; the caller writes a new snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.functions import text as X
from reelbook.operators.describe import description_text, require_teams_and_tournament
from reelbook.operators.joins import lookup, new_games
from reelbook.operators.listings import expired_images
from reelbook.operators.numbering import surrogate_keys
from reelbook.operators.teams import identify_teams
from reelbook.session import stage
from reelbook.sources.documents import initial_edit_document


def next_key(table: DataFrame) -> Column:
    """Highest key in use, as a scalar."""
    return table.agg(F.coalesce(F.max("pk"), F.lit(0)).alias("last")).scalar()


def _replace(df: DataFrame, columns: Sequence[str], new: dict[str, Column]) -> DataFrame:
    """Select ``columns`` of ``df`` with some of them replaced."""
    return df.select([new[c].alias(c) if c in new else F.col(c) for c in columns])


# --- online catalogue -------------------------------------------------------------------------


def _settled(items: DataFrame, order: Sequence[str], update_on: str) -> DataFrame:
    """What a sequence of items leaves per video: video_id, title, date, status, renamed.

    Items apply one after the other and an item with the current title changes nothing, so date and
    status come from the first item of the last run of equal titles. ``renamed`` tells that another
    title came before that run. Ids with a single title, nearly all, are settled by the one pass over
    the items; the others are looked up again.
    """
    row = F.struct("title", "date", "status")
    seen = items.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("_at", F.struct(*order))
    if update_on == "any":
        last = seen.groupBy("video_id").agg(F.max_by(row, "_at").alias("_row"))
        return stage(last.select("video_id", "_row.*", F.lit(True).alias("renamed")), "settled")
    per_id = seen.groupBy("video_id").agg(
        F.min_by(row, "_at").alias("_row"), F.max_by("title", "_at").alias("_final"), F.min("title").alias("_low"), F.max("title").alias("_high")
    )
    # Partitioned by the flag, the few mixed ids have a known size when the join with them is planned.
    per_id = stage(
        per_id.select("video_id", "_row.*", "_final", (F.col("_low") != F.col("_high")).alias("renamed")),
        "settled", partition_by="renamed",
    )
    mixed = seen.join(per_id.where(F.col("renamed")).select("video_id", "_final"), "video_id")
    other = mixed.where(F.col("title") != F.col("_final")).groupBy("video_id").agg(F.max("_at").alias("_other"))
    run = mixed.join(other, "video_id").where(F.col("_at") > F.col("_other"))
    moved = run.groupBy("video_id").agg(F.min_by(row, "_at").alias("_row"))
    return per_id.where(~F.col("renamed")).drop("_final").unionByName(
        moved.select("video_id", "_row.*", F.lit(True).alias("renamed"))
    )


def settled_items(items: DataFrame, *, order: Sequence[str] = ("page_no", "item_pos"), update_on: str = "title") -> DataFrame:
    """What a sequence of items leaves per video, stored: video_id, title, date, status, renamed (see :func:`apply_settled`)."""
    if update_on not in ("title", "any"):
        raise ValueError("update_on is 'title' or 'any'")
    return _settled(items, order, update_on)


def apply_settled(yt_videos: DataFrame, settled: DataFrame, last: Column) -> DataFrame:
    """The online videos after settled items: known ids changed where the title differs, new ids added with keys after ``last``.

    Either side moves once for each of the two joins; the new ids alone are stored, to be numbered.
    """
    source = settled.select("video_id", F.col("title").alias("_title"), F.col("date").alias("_date"), F.col("status").alias("_status"), "renamed")
    takes = F.col("_title").isNotNull() & (F.col("renamed") | ~F.col("_title").eqNullSafe(F.col("title")))
    kept = _replace(yt_videos.join(source, "video_id", "left"), yt_videos.columns, {
        "title": F.when(takes, F.col("_title")).otherwise(F.col("title")),
        "publication_date": F.when(takes, F.col("_date")).otherwise(F.col("publication_date")),
        "privacy_status": F.when(takes, F.col("_status")).otherwise(F.col("privacy_status")),
    })
    fresh = source.join(yt_videos.select("video_id"), "video_id", "left_anti").select(
        "video_id",
        F.col("_title").alias("title"),
        F.lit(None).cast("bigint").alias("linked_video"),
        F.col("_date").alias("publication_date"),
        F.col("_status").alias("privacy_status"),
    )
    return kept.unionByName(surrogate_keys(fresh, ["video_id"], last))


def upsert_catalogue(yt_videos: DataFrame, items: DataFrame, *, order: Sequence[str] = ("page_no", "item_pos"),
                     update_on: str = "title") -> DataFrame:
    """The online videos after a catalogue sync.

    New ids are inserted. A known id takes title, date and status when its title differs, and nothing
    otherwise; ``update_on='any'`` always takes the last item.
    """
    return apply_settled(yt_videos, settled_items(items, order=order, update_on=update_on), next_key(yt_videos))


def _single(changes: DataFrame, key: str) -> DataFrame:
    """The changes with a true ``_hit``; two changes of one key fail the job instead of doubling the row.

    Rows of a key are counted where they lie sorted for the join that follows, so this moves nothing more.
    """
    several = F.raise_error(F.concat(F.lit(f"several changes of {key} "), F.col(key).cast("string")))
    n = F.count("*").over(Window.partitionBy(key))
    return changes.withColumn("_hit", F.when((n > 1) & F.col(key).isNotNull(), several.cast("boolean")).otherwise(F.lit(True)))


def apply_publish_response(yt_videos: DataFrame, responses: DataFrame) -> DataFrame:
    """The online videos with title, date and status of an update response (video_id, title, date, status), one per video."""
    source = _single(responses.select(
        "video_id", F.col("title").alias("_title"), F.col("date").alias("_date"), F.col("status").alias("_status")
    ), "video_id")

    def take(new, old):
        return F.when(F.col("_hit"), F.col(new)).otherwise(F.col(old))

    return _replace(yt_videos.join(source, "video_id", "left"), yt_videos.columns, {
        "title": take("_title", "title"),
        "publication_date": take("_date", "publication_date"),
        "privacy_status": take("_status", "privacy_status"),
    })


def apply_response_description(recordings: DataFrame, yt_videos: DataFrame, responses: DataFrame) -> DataFrame:
    """The recordings with the description of the response to their online video; the last video counts."""
    linked = yt_videos.where(F.col("linked_video").isNotNull()).select("video_id", "pk", "linked_video")
    given = _single(responses.select("video_id", "description"), "video_id").where("_hit").drop("_hit")
    texts = linked.join(given, "video_id").groupBy("linked_video").agg(
        F.max_by("description", "pk").alias("_description"), F.lit(True).alias("_hit")
    )
    joined = lookup(recordings, texts, "pk", {"_description": "_description", "_hit": "_hit"}, key="linked_video")
    return _replace(joined, recordings.columns, {
        "description": F.when(F.col("_hit"), F.col("_description")).otherwise(F.col("description")),
    })


# --- recordings -------------------------------------------------------------------------------


def with_details(recordings: DataFrame, tournaments: DataFrame, team_logos: DataFrame) -> DataFrame:
    """Recordings with the names and links that titles and descriptions are made of."""
    df = lookup(recordings, tournaments, "tournament", {
        "tournament_name": "name", "tournament_date": "date", "tournament_tugeny_link": "tugeny_link",
        "tournament_JTR": "JTR",
    })
    df = lookup(df, team_logos, "team1", {"team1_name": "name"})
    return lookup(df, team_logos, "team2", {"team2_name": "name"})


def reset_metadata(recordings: DataFrame, tournaments: DataFrame, team_logos: DataFrame,
                   probes: DataFrame) -> DataFrame:
    """The recordings with teams, description and title derived anew.

    ``probes`` holds (video, chapters), one per video, or the job fails. A recording without a tournament stays as it is.
    """
    old = {c: F.col(c).alias(f"_old_{c}") for c in ("team1", "team2")}
    named = identify_teams(recordings.select("*", *old.values()), team_logos)
    probed = _single(probes.select("video", "chapters"), "video").where("_hit")
    df = lookup(with_details(named, tournaments, team_logos), probed, "pk", {"_chapters": "chapters"}, key="video")
    ready = F.col("tournament_name").isNotNull() & F.col("team1_name").isNotNull() & F.col("team2_name").isNotNull()

    def when_ready(new: Column, old_value: str) -> Column:
        return F.when(ready, new).otherwise(F.col(old_value))

    return _replace(df, recordings.columns, {
        "team1": when_ready(F.col("team1"), "_old_team1"),
        "team2": when_ready(F.col("team2"), "_old_team2"),
        "description": when_ready(description_text(F.col("_chapters")), "description"),
        "video_name": when_ready(X.video_title("team1_name", "team2_name", "tournament_name"), "video_name"),
    })


def create_recordings(files: DataFrame, recordings: DataFrame, tournaments: DataFrame, team_logos: DataFrame,
                      probes: DataFrame, as_of: Column) -> DataFrame:
    """Recordings for new files (name, tournament), with new keys. ``probes`` holds (name, tournament, chapters), one per file, or the job fails."""
    named = identify_teams(files.select("name", "tournament").distinct(), team_logos)
    details, _ = require_teams_and_tournament(with_details(named, tournaments, team_logos))
    file = F.struct("name", "tournament").alias("_file")
    probed = _single(probes.select(file, F.col("chapters").alias("_chapters")), "_file").where("_hit").select("_file.*", "_chapters")
    df = details.join(probed, ["name", "tournament"], "left")
    none = F.lit(None).cast("bigint")
    rows = _replace(df, [c for c in recordings.columns if c != "pk"], {
        "time_code": X.draw_time_code("name", "tournament"),
        "miniature_x_offset": F.lit(0.0),
        "miniature_y_offset": F.lit(0.0),
        "miniature_zoom": F.lit(1.0),
        "base_image": none,
        "miniature_image": none,
        "video_name": X.video_title("team1_name", "team2_name", "tournament_name", name="name"),
        "description": description_text(F.col("_chapters")),
        "publication_date": X.default_publication(as_of),
    })
    return surrogate_keys(rows, ["tournament", "name"], next_key(recordings)).select(recordings.columns)


def fold_patches(patches: DataFrame, columns: Sequence[str], order: str, *, method: str = "PATCH") -> DataFrame:
    """Several updates of a row as one: each column's last given value, or the last update whole for PUT."""
    if method == "PUT":
        last = patches.groupBy("pk").agg(F.max_by(F.struct(*columns), order).alias("_last"))
        return last.select("pk", "_last.*")
    parts = []
    for c in columns:
        flag = F.coalesce(f"{c}_set", F.lit(False)) if f"{c}_set" in patches.columns else F.lit(False)
        given = F.when(F.col(c).isNotNull() | flag, F.col(order))
        parts.append(F.max_by(c, given).alias(c))
        if f"{c}_set" in patches.columns:
            parts.append(F.max_by(flag, given).alias(f"{c}_set"))
    return patches.groupBy("pk").agg(*parts)


def apply_patch(table: DataFrame, patches: DataFrame, columns: Sequence[str], *, method: str = "PATCH",
                order: str | None = None) -> DataFrame:
    """The table after partial (PATCH) or full (PUT) updates keyed by pk.

    PATCH keeps a column whose patch value is null, unless the patch has a true ``<column>_set``,
    which makes null the value. PUT takes every listed column. ``order`` names the column that tells which of several updates
    of a row is later; without it two updates of a row fail the job.
    """
    if method not in ("PATCH", "PUT"):
        raise ValueError("method is 'PATCH' or 'PUT'")
    if order is not None:
        patches = fold_patches(patches, columns, order, method=method)
    flags = [f"{c}_set" for c in columns if f"{c}_set" in patches.columns]
    side = _single(patches.select("pk", *[F.col(c).alias(f"_new_{c}") for c in columns], *[F.col(f).alias(f"_{f}") for f in flags]), "pk")

    def value(c: str) -> Column:
        new, old = F.col(f"_new_{c}"), F.col(c)
        if method == "PUT":
            return F.when(F.col("_hit"), new).otherwise(old)
        given = F.coalesce(new, old)
        if f"{c}_set" in flags:
            given = F.when(F.col(f"_{c}_set"), new).otherwise(given)
        return F.when(F.col("_hit"), given).otherwise(old)

    return _replace(table.join(side, "pk", "left"), table.columns, {c: value(c) for c in columns})


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def apply_crop_edit(recordings: DataFrame, edits: DataFrame, tournaments: DataFrame, team_logos: DataFrame,
                    probes: DataFrame) -> DataFrame:
    """The recordings after thumbnail edits.

    ``edits`` holds pk, text values of the four crop fields, and ``team1`` / ``team2`` keys already
    resolved from their URLs. The crop fields are read in order and the first that is no number ends
    the reading; an absent one keeps its value. ``team2`` is looked at once ``team1`` is resolved. A
    changed team renews description and title; without a tournament such an edit is refused whole. Two edits of a recording, or
    two probes, fail the job.
    """
    fields = ["miniature_x_offset", "miniature_y_offset", "miniature_zoom", "time_code"]
    side = edits.select(
        "pk", *[F.col(c).alias(f"_new_{c}") for c in fields], F.col("team1").alias("_new_team1"), F.col("team2").alias("_new_team2")
    )
    df = recordings.join(_single(side, "pk").where("_hit").drop("_hit"), "pk", "left")
    new: dict[str, Column] = {}
    readable = F.lit(True)
    for c in fields:
        text = F.col(f"_new_{c}")
        readable = readable & (text.isNull() | text.rlike(_NUMBER))
        number = F.trim(text).try_cast("double")
        new[c] = F.when(readable, F.coalesce(number, F.col(c))).otherwise(F.col(c))
    team1 = F.coalesce("_new_team1", "team1")
    team2 = F.when(F.col("_new_team1").isNotNull(), F.coalesce("_new_team2", "team2")).otherwise(F.col("team2"))
    changed = ~team1.eqNullSafe(F.col("team1")) | ~team2.eqNullSafe(F.col("team2"))
    df = df.select(
        *[F.col(c).alias(f"_old_{c}") for c in recordings.columns],
        *[(new[c] if c in new else {"team1": team1, "team2": team2}.get(c, F.col(c))).alias(c) for c in recordings.columns],
        changed.alias("_changed"),
    )
    df = lookup(with_details(df, tournaments, team_logos), _single(probes.select("video", "chapters"), "video").where("_hit"), "pk", {"_chapters": "chapters"}, key="video")
    complete = F.col("tournament_name").isNotNull() & F.col("team1_name").isNotNull() & F.col("team2_name").isNotNull()
    renewed = {
        "description": F.when(F.col("_changed"), description_text(F.col("_chapters"))).otherwise(F.col("description")),
        "video_name": F.when(
            F.col("_changed"), X.video_title("team1_name", "team2_name", "tournament_name")
        ).otherwise(F.col("video_name")),
    }
    refused = F.col("_changed") & ~complete
    return df.select([
        F.when(refused, F.col(f"_old_{c}")).otherwise(renewed.get(c, F.col(c))).alias(c) for c in recordings.columns
    ])


# --- games ------------------------------------------------------------------------------------


def generate_games(grouped: DataFrame, games: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Games, with their first edit document, for recordings that are not games yet.

    ``grouped`` holds tournament, key, files of the split recordings.
    """
    base_name = F.format_string(C.EDIT_DOCUMENT_NAME_FORMAT, F.col("key"))
    fresh = new_games(grouped.withColumn("source_name", F.col("key").cast("string")), games)
    named = lookup(fresh, tournaments, "tournament", {"_tournament": "name", "_dir": "source_dir"})
    none = F.lit(None).cast("bigint")
    rows = named.select(
        F.col("source_name").alias("name"),
        "source_name",
        "tournament",
        none.alias("team1"),
        none.alias("team2"),
        F.lit("").alias("rendered"),
        F.concat(F.lit("json_files/"), "_tournament", F.lit("_"), "source_name", F.lit("_game.json")).alias("json_file"),
        F.lit("").alias("source_proxy"),
        X.slugify(base_name).alias("slug"),
        initial_edit_document(F.col("_dir"), F.col("files"), base_name).alias("document"),
    )
    return surrogate_keys(rows, ["tournament", "source_name"], next_key(games))


# --- deletion ---------------------------------------------------------------------------------


def _stored_sets(sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Key sets of several tables, distinct and stored in one go."""
    named = reduce(DataFrame.unionByName, [keys.select("pk", F.lit(name).alias("_table")) for name, keys in sets.items()])
    stored = stage(named.where(F.col("pk").isNotNull()).distinct(), "gone", partition_by="_table")
    return {name: stored.where(F.col("_table") == name).select("pk") for name in sets}


def gone_keys(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys of all rows that go when the given ones do (table -> pk rows), each set made once and stored.

    Level by level along the foreign keys: rows that go with a row they refer to, and the thumbnail images of recordings.
    """
    fresh = _stored_sets({name: keys.select("pk") for name, keys in deleted.items()}) if deleted else {}
    gone = dict(fresh)
    while fresh:
        also: dict[str, list[DataFrame]] = {}
        for entity, keys in C.FOREIGN_KEYS.items():
            for fk, target, action in keys:
                if action == "cascade" and target in fresh:
                    also.setdefault(entity, []).append(tables[entity].join(fresh[target].select(F.col("pk").alias(fk)), fk, "left_semi").select("pk"))
        if "video_metadata" in fresh:
            shown = tables["video_metadata"].join(fresh["video_metadata"], "pk", "left_semi").select(F.col("miniature_image").alias("pk"))
            also.setdefault("tmp_images", []).append(shown)
        parts = {entity: reduce(DataFrame.unionByName, found) for entity, found in also.items()}
        fresh = _stored_sets({e: k.join(gone[e], "pk", "left_anti") if e in gone else k for e, k in parts.items()}) if parts else {}
        gone |= {e: k if e not in gone else gone[e].unionByName(k) for e, k in fresh.items()}
    return gone


def without_references(table: DataFrame, references: list[tuple[str, str]], gone: dict[str, DataFrame]) -> DataFrame:
    """A table whose references (foreign key, table) to rows that go are null.

    All foreign keys of a row are looked up at once, as rows of (table, key); the table itself moves once at most, to meet the few
    rows that have such a reference.
    """
    keys = reduce(DataFrame.unionByName, [gone[target].select(F.lit(target).alias("_target"), F.col("pk").alias("_key")) for target in dict.fromkeys(t for _, t in references)])
    entries = F.array(*[F.struct(F.lit(target).alias("_target"), F.col(fk).cast("bigint").alias("_key"), F.lit(fk).alias("_fk")) for fk, target in references])
    held = table.select("pk", F.explode(entries).alias("_e")).select("pk", "_e.*").where(F.col("_key").isNotNull())
    hit = held.join(keys, ["_target", "_key"], "left_semi").groupBy("pk").agg(F.collect_set("_fk").alias("_lost"))
    lost = F.coalesce("_lost", F.array().cast("array<string>"))
    return _replace(table.join(hit, "pk", "left"), table.columns, {fk: F.when(~F.array_contains(lost, fk), F.col(fk)) for fk, _ in references})


def delete_cascade(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after deleting the given keys (table -> pk rows), and the paths of files to remove.

    Games go with their tournament and a recording takes its thumbnail image along. Other references
    become null, except a team's logo, which is left as it is.
    """
    gone = gone_keys(tables, deleted)
    after = {}
    for name, table in tables.items():
        left = table.join(gone[name], "pk", "left_anti").select(table.columns) if name in gone else table
        references = [(fk, target) for fk, target, action in C.FOREIGN_KEYS.get(name, []) if action == "null" and target in gone]
        after[name] = without_references(left, references, gone) if references else left
    images = tables["tmp_images"]
    paths = (
        images.join(gone["tmp_images"], "pk", "left_semi") if "tmp_images" in gone else images.where(F.lit(False))
    ).select(F.col("image").alias("path"))
    return after, paths


def purge_images(tables: dict[str, DataFrame], as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after removing the expired images, and the paths of their files."""
    return delete_cascade(tables, {"tmp_images": expired_images(tables["tmp_images"], as_of)})
