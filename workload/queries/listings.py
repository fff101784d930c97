"""Projections, filters, validation and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.functions import text as X
from reelbook.operators import changes, describe, joins, linking, listings, quality, teams
from reelbook.sources import files
from workload.fixtures import AS_OF, TOURNAMENT, Tables
from workload.registry import query, register

for _entity, _fields in listings.PUBLIC_FIELDS.items():
    register(
        f"project_{_entity}",
        lambda t, e=_entity: listings.project(t[e], e),
        f"select {', '.join(_fields)} from {{{_entity}}}",
    )

_ADMIN_SQL = {
    "tournaments": "select name, short_name, place, date, JTR, tugeny_link from {tournaments}",
    "games": """
        select g.name, t.name as tournament, a.name as team1, b.name as team2, g.rendered, g.json_file from {games} g
        left join {tournaments} t on t.pk = g.tournament left join {teams} a on a.pk = g.team1 left join {teams} b on b.pk = g.team2""",
    "teams": "select t.name, l.name as logo from {teams} t left join {team_logos} l on l.pk = t.logo",
    "video_metadata": """
        select v.name, t.name as tournament, a.name as team1, b.name as team2, v.publication_date, v.time_code from {video_metadata} v
        left join {tournaments} t on t.pk = v.tournament left join {team_logos} a on a.pk = v.team1
        left join {team_logos} b on b.pk = v.team2""",
    "tmp_images": "select name, image from {tmp_images}",
    "yt_videos": "select title, video_id, publication_date from {yt_videos} order by publication_date desc",
}
for _entity, _sql in _ADMIN_SQL.items():
    register(f"admin_list_{_entity}", lambda t, e=_entity: listings.admin_list(t.entities, e), _sql)

for _name, (_table, _fk, _order) in listings.CHILDREN.items():
    register(
        f"by_foreign_key_{_name}",
        lambda t, table=_table, fk=_fk, order=_order: listings.by_foreign_key(t[table], fk, order).select(fk, "pk", order)
        if order != "pk" else listings.by_foreign_key(t[table], fk, order).select(fk, "pk"),
        f"select {_fk}, pk{', name' if _order == 'name' else ''} from {{{_table}}} where {_fk} is not null",
    )
register(
    "by_foreign_key",
    lambda t: listings.by_foreign_key(t["video_metadata"], "tournament", value=TOURNAMENT).select("pk", "name", "tournament"),
    f"select pk, name, tournament from {{video_metadata}} where tournament = {TOURNAMENT} order by name, pk",
)


@query("metadata_public_view", """
    select v.pk, case when t.pk is not null then concat(a.name, ' vs ', b.name, ' | ', upper(t.name), ' [JUGGER]') end as vid_name,
           v.description, strftime(v.publication_date, '%Y-%m-%dT%H:%M') as pub_date
    from {video_metadata} v join {team_logos} a on a.pk = v.team1 join {team_logos} b on b.pk = v.team2
    left join {tournaments} t on t.pk = v.tournament""")
def metadata_public_view(t: Tables):
    details = changes.with_details(t["video_metadata"], t["tournaments"], t["team_logos"])
    return describe.metadata_public_view(details)


@query("filter_by_tournament", f"select pk, name from {{video_metadata}} where tournament = {TOURNAMENT}")
def filter_by_tournament(t: Tables):
    return listings.filter_by_tournament(t["video_metadata"], TOURNAMENT).select("pk", "name")


@query("expired_images", f"""
    select * from {{tmp_images}} where date between date '2011-01-01' and cast(TS'{AS_OF}' as date)""")
def expired_images(t: Tables):
    return listings.expired_images(t["tmp_images"], t.as_of)


@query("title_match_exact", f"""
    select * from {{yt_videos}} y where exists (
        select 1 from {{video_metadata}} v where v.name = y.title and v.tournament = {TOURNAMENT})
    or y.title in (select video_name from {{video_metadata}})""")
def title_match_exact(t: Tables):
    return linking.title_match_exact(t["yt_videos"], t["video_metadata"], TOURNAMENT)


@query("unlinked_candidates", """
    select * from {yt_videos} y where linked_video is null and (
        title in (select split_part(name, '.', 1) from {video_metadata}) or title in (select video_name from {video_metadata}))""")
def unlinked_candidates(t: Tables):
    return linking.unlinked_candidates(t["yt_videos"], t["video_metadata"])


@query("ci_contains", """
    select v.pk, contains(lower(v.name), lower(l.name)) as has_name, contains(lower(v.name), lower(l.short_name)) as has_short
    from {video_metadata} v join {team_logos} l on l.pk = v.team2""")
def ci_contains(t: Tables):
    """Does the file name spell the team the recording is assigned to?"""
    df = joins.lookup(t["video_metadata"], t["team_logos"], "team2", {"_name": "name", "_short": "short_name"})
    return df.where(F.col("_name").isNotNull()).select(
        "pk", X.ci_contains("name", "_name").alias("has_name"), X.ci_contains("name", "_short").alias("has_short")
    )


@query("filename_pattern", """
    select tournament, name, cast(substr(name, 3, 2) as bigint) as part, cast(substr(name, 5, 4) as bigint) as key
    from {recording_files} where regexp_matches(name, '^GX[0-9]+[.]MP4$') and length(name) = 12""")
def filename_pattern(t: Tables):
    return files.camera_parts(t["recording_files"]).select("tournament", "name", "part", "key")


@query("validate_crop", """
    select pk, concat_ws(',', case when time_code < 0 or time_code > 1 then 'time_code' end,
        case when miniature_x_offset < 0 or miniature_x_offset > 1 then 'miniature_x_offset' end,
        case when miniature_y_offset < 0 or miniature_y_offset > 1 then 'miniature_y_offset' end,
        case when miniature_zoom < 1 or miniature_zoom > 5 then 'miniature_zoom' end) as reasons
    from {video_metadata} where not (time_code between 0 and 1 and miniature_x_offset between 0 and 1
        and miniature_y_offset between 0 and 1 and miniature_zoom between 1 and 5)""")
def validate_crop(t: Tables):
    return quality.validate_crop(t["video_metadata"]).select("pk", F.array_join("reasons", ",").alias("reasons"))


@query("validate_entities", """
    select * from (
        select 'video_metadata' as entity, pk, concat_ws(',', case when description = '' then 'description required' end,
            case when team1 is null then 'team1 required' end, case when team2 is null then 'team2 required' end,
            case when length(video_name) > 120 then 'video_name too long' end) as reasons from {video_metadata}
        union all
        select 'cuts', pk, case when type_cut not in ('MAN', 'VID', 'XML', 'ML', 'X') then 'type_cut unknown' else '' end from {cuts}
        union all
        select 'tournaments', pk, case when length(name) > 100 then 'name too long' else '' end from {tournaments}
        union all
        select 'yt_videos', pk, case when length(title) > 150 then 'title too long' else '' end from {yt_videos}
    ) where reasons <> ''""")
def validate_entities(t: Tables):
    return quality.validate_entities(t.entities).select("entity", "pk", F.array_join("reasons", ",").alias("reasons"))


@query("require_teams_and_tournament", """
    select v.pk, v.tournament is not null and v.team1 is not null and v.team2 is not null as complete from {video_metadata} v""")
def require_teams_and_tournament(t: Tables):
    details = changes.with_details(t["video_metadata"], t["tournaments"], t["team_logos"])
    ok, rejected = describe.require_teams_and_tournament(details)
    return ok.select("pk", F.lit(True).alias("complete")).unionByName(rejected.select("pk", F.lit(False).alias("complete")))


@query("order_by_name", "select pk, name from {video_metadata} order by name, pk")
def order_by_name(t: Tables):
    return listings.order_by_name(t["video_metadata"].select("pk", "name"))


@query("recent_online_videos", "select pk, title, publication_date from {yt_videos} order by publication_date desc, pk limit 20")
def recent_online_videos(t: Tables):
    return listings.recent_online_videos(t["yt_videos"].select("pk", "title", "publication_date"), 20)


@query("order_by_abbreviation_length", "select pk, short_name from {team_logos} order by length(short_name), pk")
def order_by_abbreviation_length(t: Tables):
    return teams.order_by_abbreviation_length(t["team_logos"].select("pk", "short_name"))


@query("limit_n", "select pk, name from {video_metadata} order by name, pk limit 2")
def limit_n(t: Tables):
    return listings.limit_n(listings.order_by_name(t["video_metadata"].select("pk", "name")), 2)
