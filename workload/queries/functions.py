"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.functions import crop
from reelbook.functions import text as X
from reelbook.operators.joins import lookup
from reelbook.plans.nested import hal_links
from workload.fixtures import AS_OF, BASE_URL, Tables
from workload.registry import query

_MMSS = """concat(case when cast(trunc({s}) as bigint) // 60 < 100 then lpad(cast(cast(trunc({s}) as bigint) // 60 as string), 2, '0')
    else cast(cast(trunc({s}) as bigint) // 60 as string) end, ':', lpad(cast(cast(trunc({s}) as bigint) % 60 as string), 2, '0'))"""


@query("mmss", f"select event_id, {_MMSS.replace('{s}', '(value * 100)')} as t from {{events}}")
def mmss(t: Tables):
    return t["events"].select("event_id", X.mmss(F.col("value") * 100).alias("t"))


_SLUG = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({s}), '[^\x00-\x7F]', '', 'g')),
    '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"""


@query("slugify", f"select pk, {_SLUG.replace('{s}', 'name')} as slug, {_SLUG.replace('{s}', 'video_name')} as title_slug from {{video_metadata}}")
def slugify(t: Tables):
    return t["video_metadata"].select("pk", X.slugify("name").alias("slug"), X.slugify("video_name").alias("title_slug"))


@query("drop_ext4", "select pk, substr(name, 1, length(name) - 4) as bare from {video_metadata}")
def drop_ext4(t: Tables):
    return t["video_metadata"].select("pk", X.drop_ext4("name").alias("bare"))


@query("stem", "select pk, split_part(name, '.', 1) as stem from {video_metadata}")
def stem(t: Tables):
    return t["video_metadata"].select("pk", X.stem("name").alias("stem"))


@query("video_title", """
    select v.pk, concat(a.name, ' vs ', b.name, ' | ', upper(t.name), ' [JUGGER]') as reset_title,
           concat(v.name, ' vs ', a.name, ' vs ', b.name, ' | ', upper(t.name), ' [JUGGER]') as creation_title
    from {video_metadata} v join {tournaments} t on t.pk = v.tournament join {team_logos} a on a.pk = v.team1
    join {team_logos} b on b.pk = v.team2""")
def video_title(t: Tables):
    df = lookup(t["video_metadata"], t["tournaments"], "tournament", {"_t": "name"})
    df = lookup(lookup(df, t["team_logos"], "team1", {"_a": "name"}), t["team_logos"], "team2", {"_b": "name"})
    return df.dropna(subset=["_t", "_a", "_b"]).select(
        "pk", X.video_title("_a", "_b", "_t").alias("reset_title"), X.video_title("_a", "_b", "_t", name="name").alias("creation_title")
    )


@query("chapter_line", f"""
    select video, start_time, concat({_MMSS.replace('{s}', 'cast(start_time as double)')}, ' Point ', cast(video as string)) as line
    from {{chapters}}""")
def chapter_line(t: Tables):
    return t["chapters"].select("video", "start_time", X.chapter_line("start_time", "video").alias("line"))


@query("default_publication", """
    select event_id, cast(cast(ts as date) as timestamp) - interval 6 hours as evening_before from {events}""")
def default_publication(t: Tables):
    return t["events"].select("event_id", X.default_publication(F.col("ts")).alias("evening_before"))


@query("effective_date", """
    select page_no, item_pos, cast(replace(substr(coalesce(publishAt, publishedAt), 1, 19), 'T', ' ') as timestamp) as date
    from {catalogue_items}""")
def effective_date(t: Tables):
    return t["catalogue_items"].select("page_no", "item_pos", X.effective_date("publishAt", "publishedAt").alias("date"))


@query("item_video_id", """
    select page_no, item_pos, case when kind = 'youtube#video' then id else resource_id end as video_id from {catalogue_items}""")
def item_video_id(t: Tables):
    return t["catalogue_items"].select("page_no", "item_pos", X.item_video_id("kind", "id", "resource_id").alias("video_id"))


@query("format_pub_date", "select pk, strftime(publication_date, '%Y-%m-%dT%H:%M') as text from {yt_videos}")
def format_pub_date(t: Tables):
    return t["yt_videos"].select("pk", X.format_pub_date("publication_date").alias("text"))


@query("publish_schedule", f"""
    select pk, case when due then 'private' end as privacy,
           case when due then concat(replace(strftime(publication_date, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', ''), '+00:00') end as publish_at
    from (select *, privacy_status in ('private', 'unlisted') and publication_date > TS'{AS_OF}' as due from {{yt_videos}})""")
def publish_schedule(t: Tables):
    plan = X.publish_schedule("privacy_status", "publication_date", t.as_of)
    return t["yt_videos"].select("pk", plan.alias("p")).select(
        "pk", F.col("p.privacyStatus").alias("privacy"), F.col("p.publishAt").alias("publish_at")
    )


@query("status_label", f"""
    select pk, case when privacy_status = 'public' then 'public' when privacy_status = 'unlisted' then 'unlisted'
        when privacy_status = 'private' and publication_date >= TS'{AS_OF}' then 'scheduled' else 'private' end as label
    from {{yt_videos}}""")
def status_label(t: Tables):
    return t["yt_videos"].select("pk", X.status_label("privacy_status", "publication_date", t.as_of).alias("label"))


@query("thumbnail_key", f"""
    select v.pk, concat_ws('_', t.slug, {_SLUG.replace('{s}', 'substr(v.name, 1, length(v.name) - 4)')}, cast(v.time_code as varchar)) as key
    from {{video_metadata}} v join {{tournaments}} t on t.pk = v.tournament""")
def thumbnail_key(t: Tables):
    df = lookup(t["video_metadata"], t["tournaments"], "tournament", {"_slug": "slug"}).dropna(subset=["_slug"])
    return df.select("pk", X.thumbnail_key("_slug", "name", "time_code").alias("key"))


@query("frame_second", """
    select v.pk, cast(trunc(m.duration * v.time_code) as int) as frame_second from {video_metadata} v join {media} m on m.pk = v.pk""")
def frame_second(t: Tables):
    return t["video_metadata"].join(t["media"], "pk").select("pk", crop.frame_second("duration", "time_code").alias("frame_second"))


_ASPECT_W = "case when cast(width as double) / height > cast(16 as double) / 9 then cast(height as double) * 16 / 9 else cast(width as double) end"
_ASPECT_H = "case when cast(width as double) / height > cast(16 as double) / 9 then cast(height as double) else cast(width as double) * 9 / 16 end"


@query("aspect_crop", f"select pk, {_ASPECT_W} as w, {_ASPECT_H} as h from {{media}}")
def aspect_crop(t: Tables):
    return t["media"].select("pk", crop.aspect_crop("width", "height").alias("a")).select(
        "pk", F.col("a.width").alias("w"), F.col("a.height").alias("h")
    )


@query("crop_window", """
    select pk, x as left, y as top, cast(x + 1920 as int) as right, cast(y + 1080 as int) as bottom from (
        select pk, cast(trunc(miniature_x_offset * (trunc(1920 * miniature_zoom) + 600 - 1920)) as int) as x,
               cast(trunc(miniature_y_offset * (trunc(1080 * miniature_zoom) - 1080)) as int) as y from {video_metadata})""")
def crop_window(t: Tables):
    window = crop.crop_window("miniature_x_offset", "miniature_y_offset", "miniature_zoom")
    return t["video_metadata"].select("pk", window.alias("w")).select("pk", "w.*")


@query("normalise_crop", """
    select pk, least(greatest(x, cast(0.0 as double)), cast(1.0 as double)) as x_offset,
           case when x between 0 and 1 and y between 0 and 1 then y when z = 1 then 0
                else least(greatest(y, cast(0.0 as double)), cast(1.0 as double)) end as y_offset, z as zoom
    from (select pk, miniature_x_offset * 2 - cast(0.5 as double) as x, miniature_y_offset as y,
                 least(greatest(miniature_zoom * 2, cast(1.0 as double)), cast(5.0 as double)) as z from {video_metadata})""")
def normalise_crop(t: Tables):
    """Rectangles moved and zoomed beyond the frame, pulled back."""
    moved = crop.normalise_crop(
        F.col("miniature_x_offset") * 2 - 0.5, F.col("miniature_y_offset"), F.col("miniature_zoom") * 2
    )
    return t["video_metadata"].select("pk", moved.alias("c")).select("pk", "c.*")


_LOGO_SQL = """
    select pk, cast({x} - trunc(w / 2) as int) as left, cast({y} - trunc(h / 2) as int) as top, w as width, h as height from (
        select pk, cast(case when s > 850 then trunc(cast(850 * 850 as double) / s) else 850 end as int) as w,
               cast(least(s, 850) as int) as h
        from (select pk, cast(trunc(cast(850 * height as double) / width) as int) as s from {media}))"""


@query("logo_box", _LOGO_SQL.replace("{x}", "300").replace("{y}", "270"))
def logo_box(t: Tables):
    return t["media"].select("pk", crop.logo_box("width", "height", (300, 270)).alias("b")).select("pk", "b.*")


@query("title_pos", """
    select pk, cast(1920 - floor(cast(width as double) * 3 / 4) - 80 as int) as left, cast(600 as int) as top from {media}""")
def title_pos(t: Tables):
    return t["media"].select("pk", crop.title_pos("width").alias("p")).select("pk", "p.*")


@query("path_join", """
    select v.pk, concat(t.source_dir, '/rendered/', v.name) as path, concat(t.source_dir, '/timelines') as timelines,
           concat(t.source_dir, '/rushs') as rushs
    from {video_metadata} v join {tournaments} t on t.pk = v.tournament""")
def path_join(t: Tables):
    df = lookup(t["video_metadata"], t["tournaments"], "tournament", {"_dir": "source_dir"}).dropna(subset=["_dir"])
    return df.select(
        "pk", X.rendered_path("_dir", "name").alias("path"), X.timelines_path("_dir").alias("timelines"),
        X.rushs_path("_dir").alias("rushs"),
    )


@query("part_file_name", """
    select distinct l_orderkey % 10000 as key, cast(l_linenumber as bigint) as part,
           concat('GX', lpad(cast(l_linenumber as string), 2, '0'), lpad(cast(l_orderkey % 10000 as string), 4, '0'), '.MP4') as name
    from {lineitem}""")
def part_file_name(t: Tables):
    rows = t["lineitem"].select((F.col("l_orderkey") % 10000).alias("key"), F.col("l_linenumber").cast("bigint").alias("part"))
    return rows.distinct().select("key", "part", X.part_file_name("part", "key").alias("name"))


@query("draw_time_code", """
    select name, tournament,
           cast(cast(concat('0x', substr(md5(concat(name, chr(1), cast(tournament as string))), 1, 8)) as bigint) as double) / 4294967296 as time_code
    from {video_files}""")
def draw_time_code(t: Tables):
    return t["video_files"].select("name", "tournament", X.draw_time_code("name", "tournament").alias("time_code"))


@query("hal_links", """
    select pk, concat('http://host/api/games/', cast(pk as string), '/') as self,
           concat('http://host/api/tournaments/', cast(tournament as string), '/') as tournament,
           case when team1 is not null then concat('http://host/api/teams/', cast(team1 as string), '/') end as team1,
           concat('http://host/api/games/', cast(pk as string), '/cuts/') as cuts
    from {games}""")
def links(t: Tables):
    df = t["games"].select("pk", hal_links("games", BASE_URL).alias("l"))
    return df.select("pk", *[F.col(f"l.{c}.href").alias(c) for c in ("self", "tournament", "team1", "cuts")])
