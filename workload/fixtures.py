"""Catalogue tables derived from the given Parquet tables.

Each table is one SQL text that Spark and DuckDB read alike. ``{name}`` stands for a given or another
derived table, ``TS'...'`` for a timestamp literal without zone.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbook.operators.describe import chapter_probes
from reelbook.operators.links import title_links
from reelbook.schemas import ENTITIES
from reelbook.session import configure, new_folder, stage

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

#: Clock and tournament of all queries that take one.
AS_OF = "2024-01-15 12:00:00"
TOURNAMENT = 2
BASE_URL = "http://host/api"

DERIVED = {
    "tournaments": """
        select cast(r_regionkey + 1 as bigint) as pk, r_name as name, substr(r_name, 1, 14) as short_name,
               date '2024-01-06' + cast(r_regionkey * 7 as int) as date,
               concat('Place ', cast(r_regionkey as string)) as place,
               concat('https://results.example/', cast(r_regionkey as string)) as JTR,
               '' as tugeny_link, '#102030' as color, concat('/data/', lower(r_name)) as source_dir,
               replace(lower(r_name), ' ', '-') as slug
        from {region}""",
    "team_logos": """
        select cast(n_nationkey + 1 as bigint) as pk, n_name as name, concat('N', cast(n_nationkey as string)) as short_name,
               concat('logos/', lower(n_name), '.png') as image
        from {nation}""",
    "teams": """
        select s_suppkey + 1 as pk, s_name as name,
               cast(case when s_suppkey % 7 = 0 then null when s_suppkey % 11 = 0 then s_nationkey + 101
                         else s_nationkey + 1 end as bigint) as logo,
               replace(lower(s_name), '#', '-') as slug
        from {supplier}""",
    "games": """
        select o_orderkey + 1 as pk, cast((o_orderkey * 2) % 10000 as string) as name,
               cast((o_orderkey * 2) % 10000 as string) as source_name, o_custkey % 5 + 1 as tournament,
               case when o_custkey % 9 = 0 then null else o_custkey % 10 + 1 end as team1,
               (o_custkey + 3) % 10 + 1 as team2, '' as rendered,
               concat('json_files/', cast(o_orderkey as string), '.json') as json_file, '' as source_proxy,
               concat('game-', cast(o_orderkey as string)) as slug
        from {orders}""",
    "cuts": """
        select event_id + 1 as pk, concat('cut ', cast(event_id as string)) as name,
               case event_type when 'click' then 'MAN' when 'view' then 'VID' when 'purchase' then 'XML'
                               when 'signup' then 'ML' else 'BAD' end as type_cut,
               concat('cuts/', cast(event_id as string), '.json') as json_file,
               case when event_id % 17 = 0 then null else concat('cut-', cast(event_id as string)) end as slug,
               case when event_id % 13 = 0 then null else user_id * 2 + 1 end as game
        from {events}""",
    "tmp_images": """
        select doc_id + 1 as pk,
               concat('img_', cast(doc_id as string), case when doc_id % 2 = 0 then '_base.jpeg' else '_thumbnail.jpeg' end) as name,
               date '2010-12-01' + cast((doc_id * 37) % 6000 as int) as date,
               concat('tmp/img_', cast(doc_id as string)) as image
        from {documents}""",
    "video_metadata": """
        select c_custkey + 1 as pk,
               case when c_custkey % 17 = 0 then concat('unknown_', cast(c_custkey as string), '.mov')
                    else concat('NATION_', cast(c_nationkey as string), ' vs NATION_',
                                cast((c_nationkey + c_custkey) % 25 as string), ' c', cast(c_custkey as string), '.mp4')
                    end as name,
               cast(case when c_custkey % 29 = 0 then null else n_regionkey + 1 end as bigint) as tournament,
               cast(c_custkey % 1000 as double) / 1000 as time_code,
               cast(c_custkey % 12 as double) / 10 as miniature_x_offset,
               cast(c_custkey % 10 as double) / 10 as miniature_y_offset,
               case when c_custkey % 19 = 0 then cast(0.5 as double) else 1 + cast(c_custkey % 5 as double) / 2 end as miniature_zoom,
               case when c_custkey % 3 = 0 then null else c_custkey % 200 + 1 end as base_image,
               case when c_custkey % 4 = 0 then null else (c_custkey + 7) % 200 + 1 end as miniature_image,
               cast(case when c_custkey % 23 = 0 then null else c_nationkey + 1 end as bigint) as team1,
               (c_nationkey + c_custkey) % 25 + 1 as team2,
               concat('NATION_', cast(c_nationkey as string), ' vs NATION_', cast((c_nationkey + c_custkey) % 25 as string),
                      ' | REGION_', cast(n_regionkey as string), ' [TAG]') as video_name,
               '' as description, TS'2024-01-01 18:00:00' as publication_date
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "yt_videos": """
        select e.event_id + 1 as pk,
               case when e.event_id % 11 = 0 then concat('zz', cast(e.event_id as string))
                    when e.event_id % 7 = 0 then v.video_name else split_part(v.name, '.', 1) end as title,
               concat('yt', cast(e.event_id as string)) as video_id,
               case when e.event_id % 4 = 0 then v.pk else null end as linked_video,
               e.ts as publication_date,
               case when e.event_type in ('view', 'click') then 'public' when e.event_type = 'purchase' then 'unlisted'
                    else 'private' end as privacy_status
        from (select *, 1 + event_id % (select count(*) from {customer}) as video_pk from {events}) e
        join {video_metadata} v on v.pk = e.video_pk""",
    # Every item comes twice; later copies differ in status, and some also in title.
    "catalogue_items": """
        with once as (
            select e.event_id, concat('yt', cast(e.event_id * 2 as string)) as vid,
                   case when e.event_id % 3 = 0 then concat('renamed ', cast(e.event_id as string))
                        else coalesce(y.title, concat('fresh ', cast(e.event_id as string))) end as title,
                   case when e.event_id % 5 = 0 then '2024-02-10T12:00:00+02:00' else null end as publishAt,
                   case when e.event_id % 6 = 0 then 'public' else 'private' end as status,
                   case when e.event_id % 2 = 0 then 'youtube#video' else 'youtube#playlistItem' end as kind
            from {events} e left join {yt_videos} y on y.pk = e.event_id * 2 + 1),
        twice as (
            select *, 0 as copy from once
            union all
            select event_id, vid, case when event_id % 10 = 0 then concat('again ', cast(event_id as string)) else title end,
                   publishAt, 'unlisted', kind, 1 from once)
        select cast(floor(event_id / 50) + copy * 10000000 as bigint) as page_no, cast(event_id % 50 as int) as item_pos, kind,
               case when kind = 'youtube#video' then vid else concat('item', cast(event_id as string)) end as id,
               case when kind = 'youtube#video' then null else vid end as resource_id,
               title, concat('text of ', vid) as description, publishAt,
               case when copy = 0 then '2024-02-01T08:30:00Z' else '2024-02-03T10:00:00Z' end as publishedAt,
               status as privacyStatus
        from twice""",
    "items": """
        select page_no, item_pos, case when kind = 'youtube#video' then id else resource_id end as video_id, title, description,
               cast(replace(substr(coalesce(publishAt, publishedAt), 1, 19), 'T', ' ') as TSTYPE) as date,
               privacyStatus as status
        from {catalogue_items}""",
    "video_files": """
        select pk as video, concat('/data/r', cast(coalesce(tournament, 1) as string), '/rendered/') as dir,
               coalesce(tournament, 1) as tournament,
               case when pk % 5 = 0 then concat('new ', name) when pk % 31 = 0 then concat(name, '.Mp4')
                    when pk % 37 = 0 then concat(name, '.txt') else name end as name
        from {video_metadata}""",
    "recording_files": """
        select distinct cast(l_suppkey % 5 + 1 as bigint) as tournament,
               concat('/data/r', cast(l_suppkey % 5 + 1 as string), '/rushs/') as dir,
               case when l_partkey % 10 = 0
                    then concat('gx', lpad(cast(l_linenumber as string), 2, '0'), lpad(cast(l_orderkey % 10000 as string), 4, '0'), '.mp4')
                    else concat('GX', lpad(cast(l_linenumber as string), 2, '0'), lpad(cast(l_orderkey % 10000 as string), 4, '0'), '.MP4')
                    end as name
        from {lineitem}""",
    "chapters": """
        select distinct l_orderkey % (select count(*) from {customer}) + 1 as video,
               cast(l_quantity * 137.5 as string) as start_time, cast(l_quantity * 137.5 + 60 as string) as end_time
        from {lineitem}""",
    "media": """
        select c_custkey + 1 as pk, cast(600 + c_custkey % 7200 as double) + cast(0.5 as double) as duration,
               cast(640 + (c_custkey * 7) % 1400 as int) as width, cast(360 + (c_custkey * 11) % 800 as int) as height
        from {customer}""",
    "logo_sizes": """
        select cast(n_nationkey + 1 as bigint) as pk, cast(100 + (n_nationkey * 37) % 900 as int) as width,
               cast(100 + (n_nationkey * 91) % 700 as int) as height
        from {nation}""",
    "title_sizes": """
        select cast(r_regionkey + 1 as bigint) as pk, cast(301 + r_regionkey * 97 as int) as width from {region}""",
    "patches": """
        select o_custkey + 1 as pk,
               case when o_custkey % 3 = 0 then null else concat('order ', cast(max(o_orderkey) as string)) end as description,
               case when o_custkey % 5 = 0 then null else concat('patched ', cast(o_custkey as string)) end as video_name,
               case when o_custkey % 2 = 0 then null else max(o_orderdate) end as publication_date,
               case when o_custkey % 4 = 1 then o_custkey % 7 + 1 else null end as base_image,
               o_custkey % 4 < 2 as base_image_set
        from {orders} group by o_custkey""",
    "edits": """
        select c_custkey + 1 as pk,
               case c_custkey % 4 when 0 then null when 1 then '0.25' when 2 then ' 1e-1 ' else 'left' end as miniature_x_offset,
               case c_custkey % 5 when 0 then 'top' when 1 then null else '0.75' end as miniature_y_offset,
               '2.5' as miniature_zoom,
               case c_custkey % 3 when 0 then '' else '0.125' end as time_code,
               case c_custkey % 6 when 0 then null when 1 then concat('http://host/api/teams/', cast(c_nationkey as string), '/')
                    when 2 then 'http://host/api/team_logos/9999/'
                    else concat('http://host/api/team_logos/', cast(c_nationkey + 1 as string), '/') end as team1_url,
               concat('/api/team_logos/', cast(c_custkey % 25 + 1 as string)) as team2_url
        from {customer}""",
    "responses": """
        select video_id, concat('sent ', title) as title, concat('about ', video_id) as description,
               TS'2024-03-01 09:00:00' as date, 'public' as status
        from {yt_videos} where privacy_status = 'unlisted'""",
    "gone_tournaments": "select pk from {tournaments} where name = 'ASIA'",
    "gone_teams": "select s_suppkey + 1 as pk from {supplier} where s_acctbal < 0",
    "gone_team_logos": "select pk from {team_logos} where name in ('NATION_3', 'NATION_11')",
    "gone_video_metadata": "select pk from {video_metadata} where name like 'unknown%'",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def _closure(text: str, found: list[str]) -> list[str]:
    for name in _REFERENCE.findall(text):
        if name in DERIVED and name not in found:
            _closure(DERIVED[name], found)
            found.append(name)
    return found


def duckdb_sql(text: str) -> str:
    """A query over the tables as one DuckDB statement over the given views."""
    ctes = [f"{name} as ({DERIVED[name]})" for name in _closure(text, [])]
    body = text.strip()
    opening = next((x for x in ("with recursive ", "with ") if body.lower().startswith(x)), None)
    if ctes and opening:
        whole = opening + ",\n".join(ctes) + ",\n" + body[len(opening):]
    else:
        whole = ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
    whole = whole.replace("TSTYPE", "timestamp").replace("TS'", "timestamp '")
    return _REFERENCE.sub(r"\1", whole)


class Tables:
    """The given and derived tables of one scale-factor folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in GIVEN:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = DERIVED[name]
                used = {n: self[n] for n in dict.fromkeys(_REFERENCE.findall(text))}
                text = text.replace("TSTYPE", "timestamp_ntz").replace("TS'", "timestamp_ntz '")
                self._made[name] = self.spark.sql(text, **used)
        return self._made[name]

    def store(self) -> Tables:
        """Write every derived table to the shared folder and use it from there, as a catalogue is kept."""
        folder = new_folder(self.spark, "tables")
        for name in DERIVED:
            self[name].write.parquet(f"{folder}/{name}")
            self._made[name] = self.spark.read.parquet(f"{folder}/{name}")
        self.title_links.count()
        return self

    @property
    def entities(self) -> dict[str, DataFrame]:
        """The eight catalogue tables."""
        return {name: self[name] for name in ENTITIES}

    @cached_property
    def title_links(self) -> DataFrame:
        """Link of every title before any change, stored: pattern, recording."""
        return stage(title_links(self["yt_videos"], self["video_metadata"]), "title-links")

    @cached_property
    def probes(self) -> DataFrame:
        """Chapter arrays per recording: video, chapters."""
        return chapter_probes(self["chapters"])

    @cached_property
    def file_probes(self) -> DataFrame:
        """Chapter arrays per listed file: name, tournament, chapters."""
        return self["video_files"].join(self.probes, "video").select("name", "tournament", "chapters")

    @property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp_ntz")


def described(rows: str, key: str, chapters: str = "{chapters}") -> str:
    """SQL of the texts of recordings: ``rows`` (tournament, new_team1, new_team2, ``key``) with title and description."""
    return f"""
        select d.*, concat_ws(chr(10), concat(l1.name, ' vs ', l2.name), 'Refered by : ', cast(t.date as varchar), '',
                              t.tugeny_link, t.JTR, '', p.points) as new_description,
               concat(l1.name, ' vs ', l2.name, ' | ', upper(t.name), ' [JUGGER]') as new_title
        from {rows} d join {{tournaments}} t on t.pk = d.tournament
        join {{team_logos}} l1 on l1.pk = d.new_team1 join {{team_logos}} l2 on l2.pk = d.new_team2
        left join (
            select video, string_agg(line, chr(10) order by n) as points from (
                select video, n, concat(case when m < 100 then lpad(cast(m as varchar), 2, '0') else cast(m as varchar) end, ':',
                                     lpad(cast(s % 60 as varchar), 2, '0'), ' Point ', cast(n as varchar)) as line
                from (select video, row_number() over (partition by video order by cast(start_time as double)) as n,
                             cast(trunc(cast(start_time as double)) as bigint) as s,
                             cast(trunc(cast(start_time as double)) as bigint) // 60 as m
                      from {chapters})) group by video) p on p.video = d.{key}"""
