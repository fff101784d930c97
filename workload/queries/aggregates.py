"""Counts, groupings, descriptions and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.operators import changes, counts, describe, quality
from reelbook.operators.joins import lookup
from reelbook.plans import nested
from reelbook.sources import files
from workload.fixtures import AS_OF, BASE_URL, Tables, described
from workload.registry import query


@query("videos_per_tournament", """
    select t.pk, t.name, count(v.pk) as n_videos from {tournaments} t left join {video_metadata} v on v.tournament = t.pk
    group by t.pk, t.name""")
def videos_per_tournament(t: Tables):
    return counts.videos_per_tournament(t["tournaments"], t["video_metadata"])


@query("tournament_count", "select count(*) as n_tournaments from {tournaments}")
def tournament_count(t: Tables):
    return counts.tournament_count(t["tournaments"])


@query("group_recording_parts", """
    select tournament, key, string_agg(cast(part as string), ',' order by part) as parts,
           string_agg(concat('GX', lpad(cast(part as string), 2, '0'), lpad(cast(key as string), 4, '0'), '.MP4'), ',' order by part) as files
    from (select distinct tournament, cast(substr(name, 3, 2) as bigint) as part, cast(substr(name, 5, 4) as bigint) as key
          from {recording_files} where name like 'GX%')
    group by tournament, key""")
def group_recording_parts(t: Tables):
    grouped = describe.group_recording_parts(files.camera_parts(t["recording_files"]), folder="tournament")
    return grouped.select(
        "tournament", "key", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"),
        F.array_join("files", ",").alias("files"),
    )


@query("publish_status_per_video", f"""
    select linked_video as video, case when privacy_status = 'public' then 'public' when privacy_status = 'unlisted' then 'unlisted'
        when privacy_status = 'private' and publication_date >= TS'{AS_OF}' then 'scheduled' else 'private' end as status
    from {{yt_videos}} y where linked_video is not null
      and pk = (select max(pk) from {{yt_videos}} z where z.linked_video = y.linked_video)""")
def publish_status_per_video(t: Tables):
    return counts.publish_status_per_video(t["yt_videos"], t.as_of)


_OWN_TEAMS = "(select *, team1 as new_team1, team2 as new_team2 from {video_metadata})"


@query("description_text", f"select pk, new_description as description from ({described(_OWN_TEAMS, 'pk')})")
def description_text(t: Tables):
    """Descriptions with the chapters in probe form, one array per recording."""
    details, _ = describe.require_teams_and_tournament(
        changes.with_details(t["video_metadata"], t["tournaments"], t["team_logos"])
    )
    df = lookup(details, t.probes, "pk", {"_chapters": "chapters"}, key="video")
    return df.select("pk", describe.description_text(F.col("_chapters")).alias("description"))


@query("description_lines", f"""
    select pk, unnest(range(1, len(lines) + 1)) as line_no, unnest(lines) as line
    from (select pk, string_split(new_description, chr(10)) as lines from ({described(_OWN_TEAMS, 'pk')}))""")
def description_lines(t: Tables):
    """Descriptions in long form, from the chapter table."""
    details, _ = describe.require_teams_and_tournament(
        changes.with_details(t["video_metadata"], t["tournaments"], t["team_logos"])
    )
    return describe.description_lines(details, t["chapters"])


@query("description_parts", f"""
    select pk, part, count(*) as n_lines, cast(0 as bigint) as unreadable, string_agg(line, chr(10) order by line_no) as text from (
        select pk, line_no, line, cast((line_no - 1) // 10 as bigint) as part from (
            select pk, unnest(range(1, len(lines) + 1)) as line_no, unnest(lines) as line
            from (select pk, string_split(new_description, chr(10)) as lines from ({described(_OWN_TEAMS, 'pk')}))))
    group by pk, part""")
def description_parts(t: Tables):
    """Descriptions in parts of ten lines, from the chapter table."""
    details, _ = describe.require_teams_and_tournament(changes.with_details(t["video_metadata"], t["tournaments"], t["team_logos"]))
    return describe.description_parts(details, t["chapters"], size=10)


@query("duplicate_keys", """
    select name, tournament, count(*) as n_rows from (
        select name, tournament from {video_metadata} union all select name, tournament from {video_files})
    where tournament is not null group by name, tournament having count(*) > 1""")
def duplicate_keys(t: Tables):
    """Which recordings would a listing of the folders violate the uniqueness of (name, tournament) with?"""
    keys = ["name", "tournament"]
    both = t["video_metadata"].select(keys).unionByName(t["video_files"].select(keys))
    return counts.duplicate_keys(both, keys)


@query("duplicate_video_ids", "select video_id, count(*) as n_rows from {items} group by video_id having count(*) > 1")
def duplicate_video_ids(t: Tables):
    return counts.duplicate_keys(t["items"], ["video_id"])


@query("team_index", """
    select distinct concat('http://host/api/team_logos/', cast(l.pk as string), '/') as url, l.name
    from {teams} t join {team_logos} l on l.pk = t.logo""")
def team_index(t: Tables):
    """Logos the teams refer to, once per URL."""
    choices = t["teams"].select(F.col("logo").alias("pk")).join(t["team_logos"].select("pk", "name"), "pk")
    return counts.team_index(choices.select(nested.entity_url("team_logos", F.col("pk"), BASE_URL).alias("url"), "name"))


@query("number_chapters", """
    select video, start_time, end_time, row_number() over (partition by video order by cast(start_time as double)) as position
    from {chapters}""")
def number_chapters(t: Tables):
    return describe.number_chapters(t["chapters"])


@query("orphan_report", """
    select 'teams' as entity, 'logo' as field, pk, logo as missing_key from {teams} where logo not in (select pk from {team_logos})
    union all select 'games', 'tournament', pk, tournament from {games} where tournament not in (select pk from {tournaments})
    union all select 'games', 'team1', pk, team1 from {games} where team1 not in (select pk from {teams})
    union all select 'games', 'team2', pk, team2 from {games} where team2 not in (select pk from {teams})
    union all select 'cuts', 'game', pk, game from {cuts} where game not in (select pk from {games})
    union all select 'video_metadata', 'tournament', pk, tournament from {video_metadata} where tournament not in (select pk from {tournaments})
    union all select 'video_metadata', 'base_image', pk, base_image from {video_metadata} where base_image not in (select pk from {tmp_images})
    union all select 'video_metadata', 'miniature_image', pk, miniature_image from {video_metadata} where miniature_image not in (select pk from {tmp_images})
    union all select 'video_metadata', 'team1', pk, team1 from {video_metadata} where team1 not in (select pk from {team_logos})
    union all select 'video_metadata', 'team2', pk, team2 from {video_metadata} where team2 not in (select pk from {team_logos})
    union all select 'yt_videos', 'linked_video', pk, linked_video from {yt_videos} where linked_video not in (select pk from {video_metadata})""")
def orphan_report(t: Tables):
    return quality.orphan_report(t.entities)
