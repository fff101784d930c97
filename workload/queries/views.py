"""Composite views: listings and nested resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbook.plans import listing, nested
from workload.fixtures import AS_OF, BASE_URL, Tables
from workload.registry import query, register


def flagship(t: Tables):
    """The listing of all recordings after team matching and linking."""
    from reelbook.operators.linking import relink_apply
    from reelbook.operators.teams import identify_teams

    named = identify_teams(t["video_metadata"], t["team_logos"])
    linked = relink_apply(t["yt_videos"], named)
    return listing.tournament_games_view(named, t["team_logos"], t["tmp_images"], linked, t.as_of)


@query("tournament_games_view", f"""
    select v.pk, v.tournament, i.image as miniature, v.name, concat(coalesce(a.name, ''), ' vs ', coalesce(b.name, '')) as teams,
           case when y.privacy_status = 'public' then 'public' when y.privacy_status = 'unlisted' then 'unlisted'
                when y.privacy_status = 'private' and y.publication_date >= TS'{AS_OF}' then 'scheduled'
                when y.pk is not null then 'private' end as status, v.description
    from {{video_metadata}} v left join {{team_logos}} a on a.pk = v.team1 left join {{team_logos}} b on b.pk = v.team2
    left join {{tmp_images}} i on i.pk = v.miniature_image
    left join (select * from (select *, row_number() over (partition by linked_video order by pk desc) as back from {{yt_videos}}
               where linked_video is not null) where back = 1) y on y.linked_video = v.pk""")
def tournament_games_view(t: Tables):
    return listing.tournament_games_view(t["video_metadata"], t["team_logos"], t["tmp_images"], t["yt_videos"], t.as_of)


@query("tournaments_view", """
    select t.pk, t.color, t.name, t.date, (select count(*) from {video_metadata} v where v.tournament = t.pk) as n_videos
    from {tournaments} t""")
def tournaments_view(t: Tables):
    return listing.tournaments_view(t["tournaments"], t["video_metadata"])


# JSON twins. A null link is left out, as merging into an empty object does.

_B = BASE_URL


def _link(url: str, fk: str | None = None) -> str:
    made = f"json_object('href', {url})"
    return f"case when {fk} is null then null else {made} end" if fk else made


def _resource_sql(entity: str, alias: str) -> str:
    route = nested.ROUTES[entity]
    fields = []
    for c in nested.PUBLIC_FIELDS[entity]:
        if c in nested.RELATION_LINKS.get(entity, {}):
            continue
        value = f"{alias}.{c}"
        if c == "publication_date":
            value = f"concat(replace(strftime({value}, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', ''), 'Z')"
        elif c == "date":
            value = f"cast({value} as varchar)"
        fields.append(f"'{c}', {value}")
    own = f"concat('{_B}/{route}/', cast({alias}.pk as varchar), '/"
    links = [f"'self', {_link(own + chr(39) + ')')}"]
    for fk, target in nested.RELATION_LINKS.get(entity, {}).items():
        url = f"concat('{_B}/{nested.ROUTES[target]}/', cast({alias}.{fk} as varchar), '/')"
        links.append(f"'{fk}', {_link(url, f'{alias}.{fk}')}")
    for name, action in nested.ACTION_LINKS.get(entity, {}).items():
        links.append(f"'{name}', {_link(own + action + '/' + chr(39) + ')')}")
    return f"json_object({', '.join(fields)}, '_links', json_object({', '.join(links)}))"


def _hal_sql(entity: str) -> str:
    body, page, joins = _resource_sql(entity, "p"), "cast(0 as bigint)", []
    embedded = []
    for fk, target in nested.EMBED_ONE.get(entity, {}).items():
        joins.append(f"left join {{{target}}} e_{fk} on e_{fk}.pk = p.{fk}")
        embedded.append(f"'{fk}', case when e_{fk}.pk is null then null else {_resource_sql(target, f'e_{fk}')} end")
    if entity in nested.EMBED_MANY:
        name, target, fk = nested.EMBED_MANY[entity]
        joins.append(f"""left join (
            select {fk} as parent, page, to_json(list({_resource_sql(target, 'c')} order by c.pk)) as children from (
                select *, (row_number() over (partition by {fk} order by pk) - 1) // {nested.PAGE_SIZE} as page from {{{target}}}
                where {fk} is not null) c group by {fk}, page) kids on kids.parent = p.pk""")
        embedded.append(f"'{name}', coalesce(kids.children, json('[]'))")
        page = "cast(coalesce(kids.page, 0) as bigint)"
    whole = body if not embedded else body[:-1] + f", '_embedded', json_object({', '.join(embedded)}))"
    return f"select p.pk, {page} as page, cast({whole} as varchar) as body from {{{entity}}} p {' '.join(joins)}"


def _drop_nulls(sql: str) -> str:
    """Take null members out of the JSON text: links of null keys and embedded null rows."""
    pattern = r"""'"(logo|tournament|team1|team2|base_image|miniature_image|game|linked_video)":null,?'"""
    cleaned = f"regexp_replace(body, {pattern}, '', 'g')"
    cleaned = f"replace({cleaned}, ',\"_embedded\":{{}}', '')"
    return f"select pk, page, replace(regexp_replace({cleaned}, ',}}', '}}', 'g'), ',]', ']') as body from ({sql})"


for _entity in nested.ROUTES:
    register(
        f"hal_{_entity}", lambda t, e=_entity: nested.hal(t.entities, e, BASE_URL), _drop_nulls(_hal_sql(_entity))
    )


_PAYLOAD = """case when pk % 4 = 0 then concat('[{"n":', cast(pk as string), '},{"n":"', name, '"}]')
                    when pk % 4 = 1 then concat('{"total":1,"_embedded":{"note":"x","videos":[{"n":', cast(pk as string), '}],"more":[1]}}')
                    when pk % 4 = 2 then concat('{"_embedded":{"video":{"n":', cast(pk as string), ',"m":"', video_name, '"}}}')
                    else '{"count":0}' end"""


@query("collection_items", """
    select pk, cast(unnest(range(len(items))) as int) as position, unnest(items) as item from (
        select pk, case pk % 4 when 0 then [concat('{"n":', cast(pk as string), '}'), concat('{"n":"', name, '"}')]
                               when 1 then [concat('{"n":', cast(pk as string), '}')]
                               when 2 then [concat('{"n":', cast(pk as string), ',"m":"', video_name, '"}')] else [] end as items
        from {video_metadata})""")
def collection_items(t: Tables):
    """Items of a payload made from every recording."""
    payloads = t["video_metadata"].select("pk", F.expr(_PAYLOAD).alias("payload"))
    return nested.collection_items(payloads, "pk")
