"""Scans, sources and sinks. Files are written from derived tables and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.operators.describe import group_recording_parts
from reelbook.schemas import ENTITIES
from reelbook.session import new_folder
from reelbook.sources import catalogue, document_store, documents, entities, files
from workload.fixtures import Tables
from workload.registry import query

_LABEL = {"yt_videos": "title"}


def _labels(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        t.select(F.lit(e).alias("entity"), "pk", F.col(_LABEL.get(e, "name")).alias("label")) for e, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_LABEL_SQL = " union all ".join(
    f"select '{e}' as entity, pk, {_LABEL.get(e, 'name')} as label from {{{e}}}" for e in ENTITIES
)


@query("scan_entities", _LABEL_SQL)
def scan_entities(t: Tables):
    return _labels(t.entities)


@query("write_entities", _LABEL_SQL)
def write_entities(t: Tables):
    """Snapshot of all tables, written and scanned again."""
    folder = new_folder(t.spark, "snapshot")
    entities.write_entities(t.entities, folder)
    return _labels(entities.scan_entities(t.spark, folder))


@query("list_video_files", r"""
    select dir, name from {video_files}
    where regexp_matches(name, '\.(mp4|MP4|MOV|mov|avi|mkv)$')""")
def list_video_files(t: Tables):
    return files.list_video_files(t["video_files"]).select("dir", "name")


@query("listed_folder")
def listed_folder(t: Tables):
    """Folder listing through the file source: one file per tournament, written first."""
    folder = new_folder(t.spark, "listing")
    t["tournaments"].select("slug", F.col("name").alias("value")).write.partitionBy("slug").text(folder)
    return files.listing(t.spark, f"{folder}/*").select("dir", "name", "length")


_ITEM_SQL = "select video_id, title, description, date, status, page_no, item_pos from {items}"


def _pages(t: Tables) -> DataFrame:
    """Page documents as the online service hands them out, 50 items a page."""
    item = F.struct(
        "kind",
        "id",
        F.struct("title", "description", "publishedAt", F.struct(F.col("resource_id").alias("videoId")).alias("resourceId")).alias("snippet"),
        F.struct("privacyStatus", "publishAt").alias("status"),
    )
    rows = t["catalogue_items"].select("page_no", F.struct("item_pos", item.alias("item")).alias("entry"))
    pages = rows.groupBy("page_no").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    return pages.select("page_no", F.transform("entries", lambda e: e["item"]).alias("items"))


def land_pages(t: Tables) -> str:
    """Write the pages as JSON lines and return the folder."""
    folder = new_folder(t.spark, "pages")
    _pages(t).write.json(folder)
    return folder


@query("ingest_catalogue_pages", _ITEM_SQL)
def ingest_catalogue_pages(t: Tables):
    return catalogue.ingest_catalogue_pages(t.spark, land_pages(t))


@query("catalogue_since", _ITEM_SQL + " where date >= TS'2024-02-02 00:00:00'")
def catalogue_since(t: Tables):
    items = catalogue.catalogue_items(_pages(t), from_date=F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"))
    return items


@query("ingest_edit_documents", """
    select key as game, tournament, 'Team1' as team1, concat('/data/r', cast(tournament as string), '/rushs/') as dir,
           string_agg(concat('GX', lpad(cast(part as string), 2, '0'), lpad(cast(key as string), 4, '0'), '.MP4'), ',' order by part) as files,
           concat('VID00', cast(key as string), '.json') as filename, false as verified, true as training, '' as game_mode,
           cast(0 as int) as n_cuts
    from (select distinct tournament, cast(regexp_extract(name, '^GX(..)(....)[.]MP4$', 2) as bigint) as key,
                 cast(regexp_extract(name, '^GX(..)(....)[.]MP4$', 1) as bigint) as part
          from {recording_files} where regexp_matches(name, '^GX[0-9]+[.]MP4$'))
    group by key, tournament""")
def ingest_edit_documents(t: Tables):
    """Edit documents of all split recordings, written as lines and read back."""
    folder = new_folder(t.spark, "edit")
    grouped = group_recording_parts(files.camera_parts(t["recording_files"]))
    name = F.format_string("VID00%d.json", "key")
    docs = grouped.select(documents.initial_edit_document(F.col("dir"), F.col("files"), name).alias("document"))
    documents.write_edit_documents(docs, folder)
    back = documents.read_edit_documents(t.spark, folder)
    return back.select(
        F.regexp_extract("filename", r"VID00(\d+)", 1).cast("bigint").alias("game"),
        F.regexp_extract("dir", r"/r(\d+)/", 1).cast("bigint").alias("tournament"),
        "team1", "dir", F.array_join("files", ",").alias("files"), "filename", "verified", "training", "game_mode",
        F.size("cuts").alias("n_cuts"),
    )


@query("write_edit_documents", """
    select concat('VID00', cast(key as string), '.json') as filename, count(*) as n_documents
    from (select distinct tournament, cast(regexp_extract(name, '^GX(..)(....)[.]MP4$', 2) as bigint) as key
          from {recording_files} where regexp_matches(name, '^GX[0-9]+[.]MP4$'))
    group by key""")
def write_edit_documents(t: Tables):
    """Documents written, then counted per file name from the text on disk."""
    folder = new_folder(t.spark, "edit")
    grouped = group_recording_parts(files.camera_parts(t["recording_files"]))
    name = F.format_string("VID00%d.json", "key")
    docs = grouped.select(documents.initial_edit_document(F.col("dir"), F.col("files"), name).alias("document"))
    documents.write_edit_documents(docs, folder)
    lines = t.spark.read.text(folder)
    return lines.groupBy(F.get_json_object("value", "$.filename").alias("filename")).agg(F.count("*").alias("n_documents"))


_LISTED = "select dir, name, video * 100 as length, TS'2024-01-01 10:00:00' as modificationTime from {video_files} where video % 13 <> 0"
_KNOWN = """select dir, name, video * 100 + case when video % 7 = 0 then 1 else 0 end as length,
    case when video % 5 = 1 then TS'2023-01-01 10:00:00' else TS'2024-01-01 10:00:00' end as modificationTime from {video_files} where video % 11 <> 0"""


@query("inventory_changes", f"""
    select coalesce(l.dir, k.dir) as dir, coalesce(l.name, k.name) as name, l.length, l.modificationTime,
           case when k.dir is null then 'new' when l.dir is null then 'gone' else 'changed' end as status
    from ({_LISTED}) l full join ({_KNOWN}) k on k.dir = l.dir and k.name = l.name
    where k.dir is null or l.dir is null or k.length <> l.length or k.modificationTime <> l.modificationTime""")
def inventory_changes(t: Tables):
    """Files that are new, changed or gone since an earlier inventory."""
    def inventory(text: str) -> DataFrame:
        return t.spark.sql(text.replace("TS'", "timestamp_ntz '"), video_files=t["video_files"])

    return files.inventory_changes(inventory(_LISTED), inventory(_KNOWN))


_DOCUMENT_SQL = """
    concat('{"team1":"Team1","team2":"Team2","dir":"', t.source_dir, '","files":["GX01', lpad(g.source_name, 4, '0'),
           '.MP4"],"filename":"VID00', g.source_name, '.json","verified":false,"training":true,"labeled":true,"rendered_file":false,',
           '"game_mode":"","cuts":[],"Warnings":[]}')"""


def _stored_documents(t: Tables):
    """A store with the edit documents of two games in three, and its first snapshot."""
    games = t["games"].where("pk % 3 <> 0").join(t["tournaments"].select(F.col("pk").alias("tournament"), "source_dir"), "tournament")
    file = F.concat(F.lit("GX01"), F.lpad("source_name", 4, "0"), F.lit(".MP4"))
    document = documents.initial_edit_document(F.col("source_dir"), F.array(file), F.concat(F.lit("VID00"), "source_name", F.lit(".json")))
    store = document_store.document_store(t.spark, new_folder(t.spark, "documents"))
    return store, document_store.create_documents(store, document_store.as_rows(games.select("json_file", document.alias("document"))), buckets=16)


@query("documents_of_games", f"""
    select g.pk, g.json_file, case when g.pk % 3 <> 0 then {_DOCUMENT_SQL} end as document
    from {{games}} g join {{tournaments}} t on t.pk = g.tournament""")
def documents_of_games(t: Tables):
    """The whole edit document of every game, by the file its row names."""
    store, snapshot = _stored_documents(t)
    return document_store.documents_of_games(store, snapshot, t["games"])


@query("set_documents_of_games", f"""
    select g.json_file, case when g.pk % 5 = 0 then concat('{{"team1":"A","note":"', cast(g.pk as string), '","cuts":[1,{{"x":null}}]}}')
                             else {_DOCUMENT_SQL} end as document
    from {{games}} g join {{tournaments}} t on t.pk = g.tournament where g.pk % 3 <> 0 or g.pk % 5 = 0""")
def set_documents_of_games(t: Tables):
    """All documents after those of every fifth game were replaced or added, fields the library does not know included."""
    store, snapshot = _stored_documents(t)
    text = F.concat(F.lit('{"team1":"A","note":"'), F.col("pk").cast("string"), F.lit('","cuts":[1,{"x":null}]}'))
    changed = t["games"].where("pk % 5 = 0").select("pk", text.alias("document"))
    return store.read(document_store.set_documents_of_games(store, snapshot, t["games"], changed))


@query("ingest_chapters", """
    select video, position,
           concat(case when m < 100 then lpad(cast(m as string), 2, '0') else cast(m as string) end, ':', lpad(cast(s % 60 as string), 2, '0')) as start,
           concat(case when m1 < 100 then lpad(cast(m1 as string), 2, '0') else cast(m1 as string) end, ':', lpad(cast(s1 % 60 as string), 2, '0')) as end
    from (select *, s // 60 as m, s1 // 60 as m1 from (
        select video, row_number() over (partition by video order by cast(start_time as double)) as position,
               cast(trunc(cast(start_time as double)) as bigint) as s, cast(trunc(cast(end_time as double)) as bigint) as s1
        from {chapters}))""")
def ingest_chapters(t: Tables):
    """Probe documents written as JSON lines and read back."""
    folder = new_folder(t.spark, "probes")
    t.probes.select(F.col("video").cast("string").alias("file"), "chapters").write.json(folder)
    probes = documents.read_chapter_probes(t.spark, folder).select(F.col("file").cast("bigint").alias("video"), "chapters")
    return documents.ingest_chapters(probes, "video")


@query("write_publish_payloads", """
    select y.video_id, v.video_name as title, v.description,
           case when y.privacy_status in ('private', 'unlisted') and v.publication_date > TS'2023-12-31 00:00:00' then 'private' end as privacy,
           case when y.privacy_status in ('private', 'unlisted') and v.publication_date > TS'2023-12-31 00:00:00'
                then concat(replace(strftime(v.publication_date, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', ''), '+00:00') end as publish_at,
           'jugger,tournament,sport' as tags, '17' as category
    from {yt_videos} y join {video_metadata} v on v.pk = y.linked_video""")
def write_publish_payloads(t: Tables):
    """Publish bodies written as JSON lines; fields taken from the text on disk."""
    folder = new_folder(t.spark, "publish")
    as_of = F.lit("2023-12-31 00:00:00").cast("timestamp_ntz")
    catalogue.write_publish_payloads(catalogue.publish_payloads(t["yt_videos"], t["video_metadata"], as_of), folder)
    body = t.spark.read.text(folder)

    def part(path):
        return F.get_json_object("value", path)

    return body.select(
        part("$.id").alias("video_id"), part("$.snippet.title").alias("title"), part("$.snippet.description").alias("description"),
        part("$.status.privacyStatus").alias("privacy"), part("$.status.publishAt").alias("publish_at"),
        F.array_join(F.from_json(part("$.snippet.tags"), "array<string>"), ",").alias("tags"),
        part("$.snippet.categoryId").alias("category"),
    )
