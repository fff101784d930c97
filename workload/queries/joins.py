"""Entity matching, record linkage and joins along keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.operators import joins, linking, teams
from reelbook.operators.describe import group_recording_parts
from reelbook.plans import nested
from reelbook.sources import files
from workload.fixtures import BASE_URL, TOURNAMENT, Tables
from workload.registry import query

#: Two best logos per file name; the brute-force form of the rule.
_BEST = """
    best as (
        select f.name, max(case when r = 1 then pk end) as m1, max(case when r = 2 then pk end) as m2
        from (select f.name, l.pk, row_number() over (partition by f.name order by length(l.short_name), l.pk) as r
              from (select distinct name from {%s}) f join {team_logos} l
                on contains(lower(f.name), lower(l.short_name)) or contains(lower(f.name), lower(l.name))) f
        where r <= 2 group by f.name)"""
_TEAM1 = "coalesce(m2, m1, (select min(pk) from {team_logos}))"
_TEAM2 = "case when m2 is not null then m1 else (select min(pk) from {team_logos}) end"


@query("identify_teams", f"""
    with {_BEST % 'video_files'}
    select f.dir, f.name, {_TEAM1} as team1, {_TEAM2} as team2 from {{video_files}} f left join best b on b.name = f.name""")
def identify_teams(t: Tables):
    return teams.identify_teams(t["video_files"].select("dir", "name"), t["team_logos"])


@query("defaults_then_matches", f"""
    with {_BEST % 'video_metadata'}
    select v.pk, {_TEAM1} as last, {_TEAM2} as before_last from {{video_metadata}} v left join best b on b.name = v.name""")
def defaults_then_matches(t: Tables):
    found = teams.identify_teams(t["video_metadata"].select("pk", "name"), t["team_logos"])
    return found.select("pk", F.col("team1").alias("last"), F.col("team2").alias("before_last"))


@query("top2_matches", f"""
    with {_BEST % 'video_files'}
    select lower(name) as text, cast(1 as bigint) as rank, m1 as logo from best where m1 is not null
    union all select lower(name), cast(2 as bigint), m2 from best where m2 is not null""")
def top2_matches(t: Tables):
    return teams.top2_matches(t["video_files"], t["team_logos"])


@query("default_team", "select f.name, f.dir, (select min(pk) from {team_logos}) as team from {video_files} f")
def default_team(t: Tables):
    return t["video_files"].select("name", "dir", teams.default_team(t["team_logos"]).scalar().alias("team"))


_RELINK = """
    select y.pk, min(v.pk) as linked_video from {{yt_videos}} y left join (select * from {{video_metadata}} {where}) v
      on contains(lower(v.name), lower(y.title)) or contains(lower(v.video_name), lower(y.title))
    group by y.pk"""


@query("relink_videos", _RELINK.format(where=""))
def relink_videos(t: Tables):
    return linking.relink_videos(t["yt_videos"], t["video_metadata"])


@query("relink_videos_one_tournament", _RELINK.format(where=f"where tournament = {TOURNAMENT}"))
def relink_videos_one_tournament(t: Tables):
    return linking.relink_videos(t["yt_videos"], t["video_metadata"], tournament=TOURNAMENT)


@query("relink_videos_latest", """
    with dated as (select *, case when pk % 7 = 0 then null else publication_date + to_days(cast(pk % 50 as int)) end as day from {video_metadata})
    select y.pk, arg_min(v.pk, struct_pack(undated := v.day is null, age := coalesce(-epoch(v.day), 0), pk := v.pk)) as linked_video
    from {yt_videos} y left join dated v on contains(lower(v.name), lower(y.title)) or contains(lower(v.video_name), lower(y.title))
    group by y.pk""")
def relink_videos_latest(t: Tables):
    """The recording published last, those without date behind."""
    day = F.expr("case when pk % 7 = 0 then null else publication_date + make_dt_interval(cast(pk % 50 as int)) end")
    return linking.relink_videos(t["yt_videos"], t["video_metadata"].withColumn("publication_date", day), latest=True)


_KEYS = f"""
    keys as (select name as title, pk from {{video_metadata}} where tournament = {TOURNAMENT}
             union select video_name, pk from {{video_metadata}})"""


@query("union_candidates", f"with {_KEYS} select * from keys")
def union_candidates(t: Tables):
    return linking.union_candidates(t["video_metadata"], TOURNAMENT)


@query("first_match", f"with {_KEYS} select title, min(pk) as pk from keys group by title")
def first_match(t: Tables):
    return linking.first_match(linking.union_candidates(t["video_metadata"], TOURNAMENT), "title", "pk")


@query("link_exact", f"""
    with {_KEYS}
    select y.pk, y.video_id, coalesce(y.linked_video, k.pk) as linked_video from {{yt_videos}} y
    left join (select title, min(pk) as pk from keys group by title) k on k.title = y.title""")
def link_exact(t: Tables):
    return linking.link_exact(t["yt_videos"], t["video_metadata"], TOURNAMENT).select("pk", "video_id", "linked_video")


_CLAIMS = """
    claims as (
        select v.pk as recording, min(y.pk) as yt_video from {video_metadata} v join {yt_videos} y
          on y.linked_video is null and y.title in (split_part(v.name, '.', 1), v.video_name)
        group by v.pk)"""


@query("link_unlinked", f"with {_CLAIMS} select * from claims")
def link_unlinked(t: Tables):
    return linking.link_unlinked(t["yt_videos"], t["video_metadata"])


@query("recording_details", """
    select v.pk, t.name as tournament_name, t.color as tournament_color, t.date as tournament_date, a.name as team1_name,
           b.image as team2_image, i.name as base_image_name, m.image as miniature_path
    from {video_metadata} v left join {tournaments} t on t.pk = v.tournament left join {team_logos} a on a.pk = v.team1
    left join {team_logos} b on b.pk = v.team2 left join {tmp_images} i on i.pk = v.base_image
    left join {tmp_images} m on m.pk = v.miniature_image""")
def recording_details(t: Tables):
    df = joins.recording_details(t["video_metadata"], t["tournaments"], t["team_logos"], t["tmp_images"])
    return df.select(
        "pk", "tournament_name", "tournament_color", "tournament_date", "team1_name", "team2_image", "base_image_name",
        "miniature_path",
    )


@query("new_recordings", """
    select name, tournament from {video_files} f where not exists (
        select 1 from {video_metadata} v where v.name = f.name and v.tournament = f.tournament)""")
def new_recordings(t: Tables):
    return joins.new_recordings(t["video_files"].select("name", "tournament"), t["video_metadata"])


@query("new_games", """
    select distinct tournament, cast(substr(name, 5, 4) as bigint) as key from {recording_files}
    where name like 'GX%' and cast(cast(substr(name, 5, 4) as bigint) as string) not in (select source_name from {games})""")
def new_games(t: Tables):
    grouped = group_recording_parts(files.camera_parts(t["recording_files"]), folder="tournament")
    named = grouped.withColumn("source_name", F.col("key").cast("string"))
    return joins.new_games(named, t["games"]).select("tournament", "key")


@query("has_linked_video", """
    select pk, name, pk in (select linked_video from {yt_videos} where linked_video is not null) as linked from {video_metadata}""")
def has_linked_video(t: Tables):
    def part(linked):
        rows = joins.has_linked_video(t["video_metadata"], t["yt_videos"], linked=linked)
        return rows.select("pk", "name", F.lit(linked).alias("linked"))

    return part(True).unionByName(part(False))


@query("resolve_entity_url", """
    select e.pk, l.pk as team1, m.pk as team2 from {edits} e
    left join {team_logos} l on e.team1_url = concat('http://host/api/team_logos/', cast(l.pk as string), '/')
    left join {team_logos} m on e.team2_url = concat('/api/team_logos/', cast(m.pk as string))""")
def resolve_entity_url(t: Tables):
    df = joins.resolve_entity_url(t["edits"], "team1_url", t["team_logos"], "team_logos", alias="team1")
    return joins.resolve_entity_url(df, "team2_url", t["team_logos"], "team_logos", alias="team2").select("pk", "team1", "team2")


@query("embed_related", """
    select v.pk, cast(coalesce(y.page, 0) as bigint) as page, t.name as tournament_name, a.name as team1_name,
           b.short_name as team2_short, cast(coalesce(y.n, 0) as int) as n_online, coalesce(y.ids, '') as online_ids
    from {video_metadata} v left join {tournaments} t on t.pk = v.tournament left join {team_logos} a on a.pk = v.team1
    left join {team_logos} b on b.pk = v.team2
    left join (select linked_video, page, count(*) as n, string_agg(video_id, ',' order by pk) as ids from (
                   select *, (row_number() over (partition by linked_video order by pk) - 1) // 2 as page
                   from {yt_videos} where linked_video is not null)
               group by linked_video, page) y on y.linked_video = v.pk""")
def embed_related(t: Tables):
    rows = nested.embed_related(
        t.entities, "video_metadata", BASE_URL, one=nested.EMBED_ONE["video_metadata"],
        many=nested.EMBED_MANY["video_metadata"], page_size=2,
    )
    return rows.select(
        "pk", "page", F.col("tournament.name").alias("tournament_name"), F.col("team1.name").alias("team1_name"),
        F.col("team2.short_name").alias("team2_short"), F.size("linked_yt_videos").alias("n_online"),
        F.array_join("linked_yt_videos.video_id", ",").alias("online_ids"),
    )
