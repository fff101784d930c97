"""Table changes: each query gives the table as it is afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.operators import changes, claims, linking, links
from reelbook.operators.describe import group_recording_parts
from reelbook.operators.joins import resolve_entity_url
from reelbook.plans import sync
from reelbook.plans.thumbnails import plan_thumbnails, publish_thumbnails
from reelbook.sources import files
from reelbook.session import new_folder
from reelbook.streaming import upsert
from workload.fixtures import AS_OF, TOURNAMENT, Tables, described
from workload.queries.joins import _BEST, _CLAIMS, _KEYS, _RELINK, _TEAM1, _TEAM2
from workload.queries.sources import land_pages
from workload.registry import query, register

# --- folder sync ------------------------------------------------------------------------------

_FRESH = """
    fresh as (
        select distinct f.name, f.tournament, f.video from {video_files} f
        where regexp_matches(f.name, '\\.(mp4|MP4|MOV|mov|avi|mkv)$')
          and not exists (select 1 from {video_metadata} v where v.name = f.name and v.tournament = f.tournament)),
    named as (select f.*, %s as new_team1, %s as new_team2 from fresh f left join best b on b.name = f.name)""" % (_TEAM1, _TEAM2)
_NEW_KEY = "(select max(pk) from {video_metadata}) + row_number() over (order by md5(concat(cast(tournament as string), chr(1), name)))"
_CREATED = f"""
    with {_BEST % 'video_files'}, {_FRESH},
    created as (
        select {_NEW_KEY} as pk, name, tournament, new_team1 as team1, new_team2 as team2,
               concat(name, ' vs ', new_title) as video_name, new_description as description,
               TS'2024-01-14 18:00:00' as publication_date,
               cast(cast(concat('0x', substr(md5(concat(name, chr(1), cast(tournament as string))), 1, 8)) as bigint) as double) / 4294967296 as time_code
        from ({described('named', 'video')}))"""


def _synced(t: Tables) -> sync.FolderSync:
    return sync.sync_recordings(
        t["video_files"], t["video_metadata"], t["tournaments"], t["team_logos"], t.file_probes, t.as_of
    )


@query("sync_recordings", _CREATED + " select * from created")
def sync_recordings(t: Tables):
    """Rows a folder sync creates."""
    return _synced(t).created.select("pk", "name", "tournament", "team1", "team2", "video_name", "description", "publication_date", "time_code")


@query("sync_recordings_listing", _CREATED + """
    select pk, name, tournament, video_name from {video_metadata} union all select pk, name, tournament, video_name from created""")
def sync_recordings_listing(t: Tables):
    """All recordings after a folder sync, in name order."""
    return _synced(t).listing().select("pk", "name", "tournament", "video_name")


_LINKED_AGAIN = _CREATED + """,
    everything as (select pk, name, video_name from {video_metadata} union all select pk, name, video_name from created)
    select y.pk, min(v.pk) as linked_video from {yt_videos} y left join everything v
      on contains(lower(v.name), lower(y.title)) or contains(lower(v.video_name), lower(y.title)) group by y.pk"""


@query("sync_recordings_links", _LINKED_AGAIN)
def sync_recordings_links(t: Tables):
    """Online videos linked again after a folder sync, from the kept links and the new recordings."""
    return _synced(t).relink_kept(t["yt_videos"], t.title_links)[0].select("pk", "linked_video")


@query("sync_recordings_relinked", _LINKED_AGAIN)
def sync_recordings_relinked(t: Tables):
    """Online videos linked again after a folder sync, all titles compared with all recordings."""
    return _synced(t).relink(t["yt_videos"]).select("pk", "linked_video")


_LINKS_OF = """
    select y.pk, min(v.pk) as linked_video from {videos} y left join {recordings} v
      on contains(lower(v.name), lower(y.title)) or contains(lower(v.video_name), lower(y.title)) group by y.pk"""


@query("links_after_deletion", _LINKS_OF.format(
    videos="{yt_videos}", recordings="(select * from {video_metadata} where pk not in (select pk from {gone_video_metadata}))"))
def links_after_deletion(t: Tables):
    """Links kept up when recordings are deleted: only titles that linked to one are looked up."""
    left = t["video_metadata"].join(t["gone_video_metadata"], "pk", "left_anti")
    kept = links.without_recordings(t.title_links, t["gone_video_metadata"], left)
    return links.apply_links(t["yt_videos"], kept).select("pk", "linked_video")


@query("links_after_patch", _LINKS_OF.format(videos="{yt_videos}", recordings="""(
    select v.pk, v.name, coalesce(p.video_name, v.video_name) as video_name from {video_metadata} v left join {patches} p on p.pk = v.pk)"""))
def links_after_patch(t: Tables):
    """Links kept up when recordings get other titles."""
    table = changes.apply_patch(t["video_metadata"], t["patches"], ["video_name"])
    renamed = table.join(t["patches"].where("video_name is not null").select("pk"), "pk", "left_semi")
    return links.apply_links(t["yt_videos"], links.with_renamed(t.title_links, renamed, table)).select("pk", "linked_video")


# --- online catalogue -------------------------------------------------------------------------

_YT = "pk, title, video_id, linked_video, publication_date, privacy_status"
_SETTLED = """
    prior as (select i.*, case when row_number() over w = 1 then y.title else lag(i.title) over w end as before,
                     row_number() over w = 1 and y.pk is null as created
              from {items} i left join {yt_videos} y on y.video_id = i.video_id
              window w as (partition by i.video_id order by i.page_no, i.item_pos)),
    applied as (select *, row_number() over (partition by video_id order by page_no desc, item_pos desc) as back from prior
                where created or title <> before),
    last as (select * from applied where back = 1),
    upserted as (
        select y.pk, coalesce(l.title, y.title) as title, y.video_id, y.linked_video,
               coalesce(l.date, y.publication_date) as publication_date, coalesce(l.status, y.privacy_status) as privacy_status
        from {yt_videos} y left join last l on l.video_id = y.video_id
        union all
        select (select max(pk) from {yt_videos}) + row_number() over (order by md5(video_id)), title, video_id, null, date, status
        from last where video_id not in (select video_id from {yt_videos}))"""


@query("upsert_catalogue", f"with {_SETTLED} select {_YT} from upserted")
def upsert_catalogue(t: Tables):
    return changes.upsert_catalogue(t["yt_videos"], t["items"])


@query("upsert_catalogue_any", f"""
    with last as (select * from (select *, row_number() over (partition by video_id order by page_no desc, item_pos desc) as back
                                 from {{items}}) where back = 1)
    select y.pk, coalesce(l.title, y.title) as title, y.video_id, y.linked_video,
           coalesce(l.date, y.publication_date) as publication_date, coalesce(l.status, y.privacy_status) as privacy_status
    from {{yt_videos}} y left join last l on l.video_id = y.video_id
    union all
    select (select max(pk) from {{yt_videos}}) + row_number() over (order by md5(video_id)), title, video_id, null, date, status
    from last where video_id not in (select video_id from {{yt_videos}})""")
def upsert_catalogue_any(t: Tables):
    """Upsert that also takes changes of date and status alone."""
    return changes.upsert_catalogue(t["yt_videos"], t["items"], update_on="any")


@query("sync_catalogue", f"""
    with {_SETTLED}, {_KEYS}
    select u.pk, u.video_id, coalesce(u.linked_video, k.pk) as linked_video from upserted u
    left join (select title, min(pk) as pk from keys group by title) k on k.title = u.title""")
def sync_catalogue(t: Tables):
    """Upsert followed by exact linking."""
    table = sync.sync_catalogue(t["yt_videos"], t["items"], t["video_metadata"], TOURNAMENT)
    return table.select("pk", "video_id", "linked_video")


@query("stream_catalogue_upsert", f"with {_SETTLED} select {_YT} from upserted")
def stream_catalogue_upsert(t: Tables):
    """Landed pages streamed into the item log, and the table the log gives."""
    log = new_folder(t.spark, "log")
    pages = upsert.read_page_stream(t.spark, land_pages(t))
    upsert.stream_catalogue_upsert(pages, log, new_folder(t.spark, "stream")).awaitTermination()
    return upsert.current_videos(t["yt_videos"], upsert.read_log(t.spark, log))


@query("links_after_upsert", f"with {_SETTLED}" + _LINKS_OF.format(videos="upserted", recordings="{video_metadata}"))
def links_after_upsert(t: Tables):
    """Links kept up when a catalogue sync brings new titles: only those are looked up."""
    table = changes.upsert_catalogue(t["yt_videos"], t["items"])
    return links.apply_links(table, links.with_titles(t.title_links, table, t["video_metadata"])).select("pk", "linked_video")


@query("upsert_catalogue_buckets", f"with {_SETTLED} select {_YT} from upserted")
def upsert_catalogue_buckets(t: Tables):
    """Upsert of online videos kept in buckets, read back from the snapshot it leaves."""
    videos = upsert.video_buckets(t.spark, new_folder(t.spark, "video-buckets"))
    first = upsert.create_video_buckets(videos, t["yt_videos"], 16)
    return videos.read(upsert.upsert_buckets(videos, first, t["items"]))


@query("stream_catalogue_buckets", f"with {_SETTLED} select {_YT} from upserted")
def stream_catalogue_buckets(t: Tables):
    """Landed pages streamed into the item log, which is compacted into the buckets of the online videos."""
    videos = upsert.video_buckets(t.spark, new_folder(t.spark, "video-buckets"))
    first = upsert.create_video_buckets(videos, t["yt_videos"], 16)
    log = new_folder(t.spark, "log")
    upsert.stream_catalogue_upsert(upsert.read_page_stream(t.spark, land_pages(t)), log, new_folder(t.spark, "stream")).awaitTermination()
    return videos.read(upsert.compact_into_buckets(videos, first, upsert.read_log(t.spark, log)))


_RELINKED = "select y.pk, y.title, y.video_id, {link} as linked_video, y.publication_date, y.privacy_status from {{yt_videos}} y join ({links}) r on r.pk = y.pk"


@query("relink_apply", _RELINKED.format(link="r.linked_video", links=_RELINK.format(where="").replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}"))
def relink_apply(t: Tables):
    return linking.relink_apply(t["yt_videos"], t["video_metadata"])


@query("relink_apply_matched", _RELINKED.format(link="coalesce(r.linked_video, y.linked_video)", links=_RELINK.format(
    where=f"where tournament = {TOURNAMENT}").replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}"))
def relink_apply_matched(t: Tables):
    """Linking for one tournament that leaves other links alone."""
    return linking.relink_apply(t["yt_videos"], t["video_metadata"], scope="matched", tournament=TOURNAMENT)


@query("claim_unlinked", f"""
    with {_CLAIMS}
    select y.pk, y.video_id, coalesce(y.linked_video, c.recording) as linked_video from {{yt_videos}} y
    left join (select yt_video, min(recording) as recording from claims group by yt_video) c on c.yt_video = y.pk""")
def claim_unlinked(t: Tables):
    return linking.claim_unlinked(t["yt_videos"], t["video_metadata"]).select("pk", "video_id", "linked_video")


@query("claim_unlinked_all", """
    with recursive free as (select pk, title from {yt_videos} where linked_video is null),
    edges as (select v.pk as recording, y.pk as video from {video_metadata} v join free y on y.title = split_part(v.name, '.', 1)
              union select v.pk, y.pk from {video_metadata} v join free y on y.title = v.video_name),
    walk as (
        select recording, video, false as won from edges
        union all
        select recording, video, won from (
            select *, bool_or(won) over (partition by recording) as served, bool_or(won) over (partition by video) as taken from (
                select recording, video, min(video) over (partition by recording) = video and min(recording) over (partition by video) = recording as won
                from walk where not won))
        where won or not (served or taken))
    select y.pk, y.video_id, coalesce(y.linked_video, w.recording) as linked_video from {yt_videos} y
    left join (select * from walk where won) w on w.video = y.pk""")
def claim_unlinked_all(t: Tables):
    """All recordings claim one after the other."""
    return claims.claim_all(t["yt_videos"], t["video_metadata"]).select("pk", "video_id", "linked_video")


@query("apply_publish_response", """
    select y.pk, coalesce(r.title, y.title) as title, y.video_id, y.linked_video, coalesce(r.date, y.publication_date) as publication_date,
           coalesce(r.status, y.privacy_status) as privacy_status
    from {yt_videos} y left join {responses} r on r.video_id = y.video_id""")
def apply_publish_response(t: Tables):
    return changes.apply_publish_response(t["yt_videos"], t["responses"])


@query("apply_response_description", """
    select v.pk, v.name, coalesce(r.description, v.description) as description from {video_metadata} v
    left join (select linked_video, arg_max(r.description, y.pk) as description from {yt_videos} y join {responses} r
                 on r.video_id = y.video_id where linked_video is not null group by linked_video) r on r.linked_video = v.pk""")
def apply_response_description(t: Tables):
    """The recordings with the description that was sent."""
    return changes.apply_response_description(t["video_metadata"], t["yt_videos"], t["responses"]).select("pk", "name", "description")


# --- recordings -------------------------------------------------------------------------------


@query("reset_metadata", f"""
    with {_BEST % 'video_metadata'},
    named as (select v.*, {_TEAM1} as new_team1, {_TEAM2} as new_team2 from {{video_metadata}} v left join best b on b.name = v.name),
    done as ({described('named', 'pk')})
    select v.pk, v.name, case when d.pk is null then v.team1 else d.new_team1 end as team1,
           case when d.pk is null then v.team2 else d.new_team2 end as team2,
           coalesce(d.new_title, v.video_name) as video_name, coalesce(d.new_description, v.description) as description
    from {{video_metadata}} v left join done d on d.pk = v.pk""")
def reset_metadata(t: Tables):
    table = changes.reset_metadata(t["video_metadata"], t["tournaments"], t["team_logos"], t.probes)
    return table.select("pk", "name", "team1", "team2", "video_name", "description")


@query("apply_patch", """
    select v.pk, coalesce(p.description, v.description) as description, coalesce(p.video_name, v.video_name) as video_name,
           coalesce(p.publication_date, v.publication_date) as publication_date,
           case when p.base_image_set then p.base_image else coalesce(p.base_image, v.base_image) end as base_image, v.name
    from {video_metadata} v left join {patches} p on p.pk = v.pk""")
def apply_patch(t: Tables):
    table = changes.apply_patch(t["video_metadata"], t["patches"], ["description", "video_name", "publication_date", "base_image"])
    return table.select("pk", "description", "video_name", "publication_date", "base_image", "name")


@query("apply_put", """
    select v.pk, case when p.pk is null then v.description else p.description end as description,
           case when p.pk is null then v.video_name else p.video_name end as video_name
    from {video_metadata} v left join {patches} p on p.pk = v.pk""")
def apply_put(t: Tables):
    """Full replacement of the listed fields."""
    table = changes.apply_patch(t["video_metadata"], t["patches"], ["description", "video_name"], method="PUT")
    return table.select("pk", "description", "video_name")


@query("apply_crop_edit", f"""
    with resolved as (
        select e.*, l.pk as t1, m.pk as t2 from {{edits}} e
        left join {{team_logos}} l on e.team1_url = concat('http://host/api/team_logos/', cast(l.pk as string), '/')
        left join {{team_logos}} m on e.team2_url = concat('/api/team_logos/', cast(m.pk as string))),
    read as (
        select v.pk, v.tournament, v.video_name, v.description, v.team1, v.team2,
               coalesce(r.t1, v.team1) as new_team1, case when r.t1 is null then v.team2 else coalesce(r.t2, v.team2) end as new_team2,
               v.miniature_x_offset as x0, v.miniature_y_offset as y0, v.miniature_zoom as z0, v.time_code as t0,
               coalesce(try_cast(trim(r.miniature_x_offset) as double), v.miniature_x_offset) as x1,
               r.miniature_x_offset is null or try_cast(trim(r.miniature_x_offset) as double) is not null as ok_x,
               r.miniature_y_offset is null or try_cast(trim(r.miniature_y_offset) as double) is not null as ok_y,
               coalesce(try_cast(r.miniature_y_offset as double), v.miniature_y_offset) as y1, cast(r.miniature_zoom as double) as z1,
               try_cast(r.time_code as double) as t1
        from {{video_metadata}} v join resolved r on r.pk = v.pk),
    changed as (select *, new_team1 is distinct from team1 or new_team2 is distinct from team2 as changed from read),
    texts as ({described('changed', 'pk')})
    select c.pk, case when refused or not ok_x then x0 else x1 end as x_offset,
           case when refused or not (ok_x and ok_y) then y0 else y1 end as y_offset,
           case when refused or not (ok_x and ok_y) then z0 else z1 end as zoom,
           case when refused or not (ok_x and ok_y) or t1 is null then t0 else t1 end as time_code,
           case when refused then team1 else new_team1 end as team1, case when refused then team2 else new_team2 end as team2,
           case when changed and not refused then new_title else video_name end as video_name,
           case when changed and not refused then new_description else description end as description
    from (select c.*, t.new_title, t.new_description, c.changed and t.pk is null as refused
          from changed c left join texts t on t.pk = c.pk) c""")
def apply_crop_edit(t: Tables):
    edits = resolve_entity_url(t["edits"], "team1_url", t["team_logos"], "team_logos", alias="team1")
    edits = resolve_entity_url(edits, "team2_url", t["team_logos"], "team_logos", alias="team2")
    table = changes.apply_crop_edit(t["video_metadata"], edits, t["tournaments"], t["team_logos"], t.probes)
    return table.select(
        "pk", F.col("miniature_x_offset").alias("x_offset"), F.col("miniature_y_offset").alias("y_offset"),
        F.col("miniature_zoom").alias("zoom"), "time_code", "team1", "team2", "video_name", "description",
    )


# --- games ------------------------------------------------------------------------------------


@query("generate_games", """
    with parts as (
        select distinct tournament, cast(substr(name, 3, 2) as bigint) as part, cast(substr(name, 5, 4) as bigint) as key
        from {recording_files} where name like 'GX%'),
    grouped as (
        select tournament, cast(key as string) as source_name,
               string_agg(concat('GX', lpad(cast(part as string), 2, '0'), lpad(cast(key as string), 4, '0'), '.MP4'), ',' order by part) as files
        from parts group by tournament, key)
    select (select max(pk) from {games}) + row_number() over (order by md5(concat(cast(tournament as string), chr(1), source_name))) as pk,
           source_name as name, source_name, tournament, concat('json_files/', t.name, '_', source_name, '_game.json') as json_file,
           concat('vid00', source_name, 'json') as slug, t.source_dir as dir, files
    from grouped g join {tournaments} t on t.pk = g.tournament
    where source_name not in (select source_name from {games})""")
def generate_games(t: Tables):
    grouped = group_recording_parts(files.camera_parts(t["recording_files"]), folder="tournament")
    return changes.generate_games(grouped, t["games"], t["tournaments"]).select(
        "pk", "name", "source_name", "tournament", "json_file", "slug", F.col("document.dir").alias("dir"),
        F.array_join("document.files", ",").alias("files"),
    )


# --- deletion ---------------------------------------------------------------------------------


def _deleted(t: Tables) -> dict[str, DataFrame]:
    return {name: t[f"gone_{name}"] for name in ("tournaments", "teams", "team_logos", "video_metadata")}


_KEY_TEXT = {
    "tournaments": [], "team_logos": [], "tmp_images": [], "teams": ["logo"], "games": ["tournament", "team1", "team2"],
    "cuts": ["game"], "video_metadata": ["tournament", "base_image", "miniature_image", "team1", "team2"], "yt_videos": ["linked_video"],
}


def _state(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows left in all tables with their foreign keys as text."""
    parts = []
    for name, fks in _KEY_TEXT.items():
        text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fks]) if fks else F.lit("")
        parts.append(tables[name].select(F.lit(name).alias("entity"), "pk", text.alias("keys")))
    return reduce(DataFrame.unionByName, parts)


def _state_sql(after: dict[str, str]) -> str:
    parts = []
    for name, fks in _KEY_TEXT.items():
        text = "concat_ws(',', " + ", ".join(f"coalesce(cast({c} as varchar), '-')" for c in fks) + ")" if fks else "''"
        parts.append(f"select '{name}' as entity, pk, {text} as keys from ({after[name]})")
    return " union all ".join(parts)


_GONE_IMAGES = "select miniature_image from {video_metadata} where pk in (select pk from {gone_video_metadata}) and miniature_image is not null"
_GONE_GAMES = "select pk from {games} where tournament in (select pk from {gone_tournaments})"


def _nulled(fk: str, gone: str) -> str:
    return f"case when {fk} in ({gone}) then null else {fk} end as {fk}"


_G = {n: f"select pk from {{gone_{n}}}" for n in ("tournaments", "teams", "team_logos", "video_metadata")}
_AFTER = {
    "tournaments": f"select * from {{tournaments}} where pk not in ({_G['tournaments']})",
    "team_logos": f"select * from {{team_logos}} where pk not in ({_G['team_logos']})",
    "tmp_images": f"select * from {{tmp_images}} where pk not in ({_GONE_IMAGES})",
    "teams": f"select * from {{teams}} where pk not in ({_G['teams']})",
    "games": f"select pk, tournament, {_nulled('team1', _G['teams'])}, {_nulled('team2', _G['teams'])} from {{games}} where pk not in ({_GONE_GAMES})",
    "cuts": f"select pk, {_nulled('game', _GONE_GAMES)} from {{cuts}}",
    "video_metadata": f"""select pk, {_nulled('tournament', _G['tournaments'])}, {_nulled('base_image', _GONE_IMAGES)},
        {_nulled('miniature_image', _GONE_IMAGES)}, {_nulled('team1', _G['team_logos'])}, {_nulled('team2', _G['team_logos'])}
        from {{video_metadata}} where pk not in ({_G['video_metadata']})""",
    "yt_videos": f"select pk, {_nulled('linked_video', _G['video_metadata'])} from {{yt_videos}}",
}
register("delete_cascade", lambda t: _state(changes.delete_cascade(t.entities, _deleted(t))[0]), _state_sql(_AFTER))
register(
    "delete_cascade_files",
    lambda t: changes.delete_cascade(t.entities, _deleted(t))[1],
    f"select image as path from {{tmp_images}} where pk in ({_GONE_IMAGES})",
)

_EXPIRED = f"select pk from {{tmp_images}} where date between date '2011-01-01' and cast(TS'{AS_OF}' as date)"
_PURGED = {
    **{n: f"select * from {{{n}}}" for n in _KEY_TEXT},
    "tmp_images": f"select * from {{tmp_images}} where pk not in ({_EXPIRED})",
    "video_metadata": f"""select pk, tournament, {_nulled('base_image', _EXPIRED)}, {_nulled('miniature_image', _EXPIRED)}, team1, team2
        from {{video_metadata}}""",
}
register("purge_images", lambda t: _state(changes.purge_images(t.entities, t.as_of)[0]), _state_sql(_PURGED))
register(
    "purge_images_files",
    lambda t: changes.purge_images(t.entities, t.as_of)[1],
    f"select image as path from {{tmp_images}} where pk in ({_EXPIRED})",
)


# --- thumbnails -------------------------------------------------------------------------------

_SLUG = r"""regexp_replace(regexp_replace(lower(substr(v.name, 1, length(v.name) - 4)), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g')"""

_LEFT = "cast(trunc(k.miniature_x_offset * (trunc(1920 * k.miniature_zoom) + 600 - 1920)) as int)"
_TOP = "cast(trunc(k.miniature_y_offset * (trunc(1080 * k.miniature_zoom) - 1080)) as int)"


def _logo_sql(size: str, name: str, x: int, y: int) -> str:
    """Box of a scaled logo around a point."""
    scaled = f"trunc(cast(850 * {size}.height as double) / {size}.width)"
    width = f"(case when {scaled} > 850 then trunc(cast(850 * 850 as double) / {scaled}) else 850 end)"
    height = f"least({scaled}, 850)"
    return f"""cast({x} - trunc({width} / 2) as int) as {name}_left, cast({y} - trunc({height} / 2) as int) as {name}_top,
           cast({width} as int) as {name}_width, cast({height} as int) as {name}_height"""


@query("plan_thumbnails", f"""
    with k as (
        select v.*, t.source_dir, t.name as tname, t.color as tcolor, a.image as image1, b.image as image2,
               concat_ws('_', t.slug, {_SLUG}, cast(v.time_code as varchar)) as key
        from {{video_metadata}} v join {{tournaments}} t on t.pk = v.tournament join {{team_logos}} a on a.pk = v.team1
        join {{team_logos}} b on b.pk = v.team2
        where v.miniature_zoom between 1 and 5 and v.miniature_x_offset between 0 and 1 and v.miniature_y_offset between 0 and 1)
    select k.pk, concat(k.source_dir, '/rendered/', k.name) as source,
           i.name is null or i.name <> concat(k.key, '_base.jpeg') as decode_frame,
           cast(trunc(m.duration * k.time_code) as int) as frame_second,
           case when m.width is not null then cast(1920 as int) end as frame_width, m.scaled as frame_height,
           case when cast(1920 as double) / m.scaled > cast(16 as double) / 9 then cast(m.scaled as double) * 16 / 9 else cast(1920 as double) end as aspect_width,
           case when cast(1920 as double) / m.scaled > cast(16 as double) / 9 then cast(m.scaled as double) else cast(1920 as double) * 9 / 16 end as aspect_height,
           {_LEFT} as window_left, {_TOP} as window_top, {_LEFT} + cast(1920 as int) as window_right, {_TOP} + cast(1080 as int) as window_bottom,
           {_logo_sql('s', 'logo1', 300, 270)}, {_logo_sql('u', 'logo2', 450, 810)},
           cast(1920 - floor(cast(z.width as double) * 3 / 4) - 80 as int) as title_left, cast(600 as int) as title_top,
           image1 as logo1_image, image2 as logo2_image, upper(tname) as title_text, tcolor as color,
           concat(k.key, '_base.jpeg') as base_target, concat(k.key, '_thumbnail.jpeg') as thumbnail_target
    from k left join {{tmp_images}} i on i.pk = k.base_image left join {{tmp_images}} n on n.pk = k.miniature_image
    left join (select *, cast(floor(cast(1920 * height as double) / width) as int) as scaled from {{media}}) m on m.pk = k.pk
    left join {{logo_sizes}} s on s.pk = k.team1 left join {{logo_sizes}} u on u.pk = k.team2 left join {{title_sizes}} z on z.pk = k.tournament
    where i.name is null or i.name <> concat(k.key, '_base.jpeg') or n.name is null or n.name <> concat(k.key, '_thumbnail.jpeg')""")
def thumbnails(t: Tables):
    plan = plan_thumbnails(t.entities, t["media"], t["logo_sizes"], t["title_sizes"])
    boxes = {"frame": ["width", "height"], "aspect": ["width", "height"], "window": ["left", "top", "right", "bottom"],
             "logo1": ["left", "top", "width", "height"], "logo2": ["left", "top", "width", "height"], "title": ["left", "top"]}
    return plan.select(
        "pk", "source", "decode_frame", "frame_second", *[F.col(f"{b}.{c}").alias(f"{b}_{c}") for b, cs in boxes.items() for c in cs],
        "logo1_image", "logo2_image", "title_text", "color", "base_target", "thumbnail_target",
    )


@query("publish_thumbnails", """
    select v.pk, y.video_id, i.image as path, case when y.video_id is null then 'no online video' when i.image is null then 'no thumbnail' end as problem
    from {video_metadata} v left join {tmp_images} i on i.pk = v.miniature_image
    left join (select linked_video, arg_min(video_id, pk) as video_id from {yt_videos} where linked_video is not null group by linked_video) y
      on y.linked_video = v.pk""")
def thumbnails_to_publish(t: Tables):
    """Thumbnail and online video of every recording, or what it lacks."""
    return publish_thumbnails(t["video_metadata"], t["yt_videos"], t["tmp_images"])
