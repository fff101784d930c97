"""New rows for the catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.operators.insert import insert_rows
from workload.fixtures import AS_OF, Tables
from workload.registry import query

_VIDEOS = """
    given as (
        select c_custkey as place, case when c_custkey % 4 <> 0 then c_name end as title,
               case when c_custkey % 5 <> 0 then concat('new-', cast(c_custkey // 2 as string)) end as video_id from {customer}
        union all
        select pk + 10000000000, title, video_id from {yt_videos} where pk % 7 = 0),
    ranked as (
        select *, exists (select 1 from {yt_videos} y where y.video_id = g.video_id) as taken,
               row_number() over (partition by video_id order by place) as turn
        from given g)"""


def _videos(t: Tables):
    place = F.col("c_custkey")
    new = t["customer"].select(
        place.alias("place"), F.when(place % 4 != 0, F.col("c_name")).alias("title"),
        F.when(place % 5 != 0, F.concat(F.lit("new-"), F.floor(place / 2).cast("string"))).alias("video_id"),
    )
    old = t["yt_videos"].where(F.col("pk") % 7 == 0).select((F.col("pk") + 10000000000).alias("place"), "title", "video_id")
    return insert_rows(t["yt_videos"], new.unionByName(old), "yt_videos", order="place", as_of=t.as_of)


@query("insert_videos", f"""
    with {_VIDEOS}
    select pk, title, video_id, linked_video, publication_date, privacy_status from {{yt_videos}}
    union all
    select (select max(pk) from {{yt_videos}}) + row_number() over (order by md5(video_id)), coalesce(title, ''), video_id, null,
           date_trunc('day', TS'{AS_OF}'), ''
    from ranked where video_id is not null and not taken and turn = 1""")
def insert_videos(t: Tables):
    """Online videos with new rows, defaults filled in."""
    return _videos(t)[0]


@query("insert_videos_refused", f"""
    with {_VIDEOS}
    select place, case when video_id is null then 'video_id required' else 'video_id not unique' end as reason
    from ranked where video_id is null or taken or turn > 1""")
def insert_videos_refused(t: Tables):
    """New online videos that were refused, with the reasons."""
    return _videos(t)[1].select("place", F.explode("reasons").alias("reason"))


@query("insert_tournaments", """
    select pk, name, short_name, date, place, JTR, tugeny_link, color, source_dir, slug from {tournaments}
    union all
    select (select max(pk) from {tournaments}) + row_number() over (order by md5(cast(n_nationkey as string))), n_name, n_name,
           date '2024-02-01', '', '', '', '#0000', '-', ''
    from {nation} where length(n_name) <= 14 and n_nationkey % 6 <> 0""")
def insert_tournaments(t: Tables):
    """Tournaments with a new one per nation; those without date or with a long name are refused."""
    day = F.when(F.col("n_nationkey") % 6 != 0, F.lit("2024-02-01").cast("date"))
    new = t["nation"].select(F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"), F.col("n_name").alias("short_name"), day.alias("date"))
    return insert_rows(t["tournaments"], new, "tournaments", order="at", as_of=t.as_of)[0]
