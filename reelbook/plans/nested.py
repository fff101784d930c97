"""Nested resource rows with links and embedded related rows.

One row of the result is one page of a resource: relations to many rows are embedded a bounded
number per page, in pk order, so a parent with very many rows becomes many rows of the result and
never one huge array. Parents without such rows, and resources without such a relation, have page 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from reelbook.functions.text import iso_utc
from reelbook.operators.listings import PUBLIC_FIELDS
from reelbook.operators.numbering import paged

PAGE_SIZE = 50

# Path segment per resource, further links, foreign keys shown as links, embedded relations.
ROUTES = {
    "tournaments": "tournaments", "teams": "teams", "games": "games", "cuts": "cuts", "team_logos": "team_logos",
    "tmp_images": "tmp_images", "video_metadata": "video_metadatas", "yt_videos": "yt_videos",
}
ACTION_LINKS = {
    "tournaments": {
        "games": "games", "video_metadatas": "videos", "sync_videos": "sync_videos", "youtube_update": "youtube-update",
    },
    "games": {"cuts": "cuts"},
    "team_logos": {"teams": "teams"},
    "video_metadata": {
        "reset_url": "reset", "upload_description": "upload-description", "upload_miniature": "upload-miniature",
        "find_ytvid": "find-ytvid", "generate_miniature": "generate_miniature", "linked_yt_videos": "linked_yt_videos",
        "reset_title_description": "reset_title_description",
    },
}
RELATION_LINKS = {
    "teams": {"logo": "team_logos"},
    "games": {"tournament": "tournaments", "team1": "teams", "team2": "teams"},
    "cuts": {"game": "games"},
    "video_metadata": {
        "tournament": "tournaments", "base_image": "tmp_images", "miniature_image": "tmp_images",
        "team1": "team_logos", "team2": "team_logos",
    },
    "yt_videos": {"linked_video": "video_metadata"},
}
#: Embedded by default: name -> (table, foreign key on this side) or (table, foreign key on the other side).
EMBED_ONE = {
    "teams": {"logo": "team_logos"},
    "video_metadata": {"tournament": "tournaments", "team1": "team_logos", "team2": "team_logos"},
    "yt_videos": {"linked_video": "video_metadata"},
}
EMBED_MANY = {
    "tournaments": ("video_metadatas", "video_metadata", "tournament"),
    "team_logos": ("teams", "teams", "logo"),
    "video_metadata": ("linked_yt_videos", "yt_videos", "linked_video"),
}


def entity_url(entity: str, pk: Column, base: str, action: str = "") -> Column:
    """URL of a row, or of one of its actions; null for a null key."""
    tail = f"/{action}/" if action else "/"
    return F.concat(F.lit(f"{base}/{ROUTES[entity]}/"), pk.cast("string"), F.lit(tail))


def hal_links(entity: str, base: str) -> Column:
    """``_links`` of a row: itself, its relations and its actions; a null relation has no link."""

    def link(url: Column) -> Column:
        return F.when(url.isNotNull(), F.struct(url.alias("href")))

    links = {"self": entity_url(entity, F.col("pk"), base)}
    links |= {fk: entity_url(target, F.col(fk), base) for fk, target in RELATION_LINKS.get(entity, {}).items()}
    links |= {name: entity_url(entity, F.col("pk"), base, a) for name, a in ACTION_LINKS.get(entity, {}).items()}
    return F.struct(*[link(url).alias(name) for name, url in links.items()])


def resource(entity: str, base: str) -> Column:
    """A row as a resource without embedded rows: fields, then links. Times are ISO text."""
    fields = []
    for name in PUBLIC_FIELDS[entity]:
        if name in RELATION_LINKS.get(entity, {}):
            continue
        column = F.col(name)
        fields.append((iso_utc(column) if name == "publication_date" else column).alias(name))
    return F.struct(*fields, hal_links(entity, base).alias("_links"))


def embed_related(tables: dict[str, DataFrame], entity: str, base: str, *, one: dict[str, str] | None = None,
                  many: tuple[str, str, str] | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows with one level of related rows: pk, page, the resource, and a column per embedded relation.

    ``one`` maps a foreign key to the table it refers to; ``many`` is (name, table, foreign key there).
    """
    df = tables[entity].select("*", resource(entity, base).alias("_resource"))
    embedded = []
    for fk, target in (one or {}).items():
        side = tables[target].select(F.col("pk").alias("_key"), resource(target, base).alias(f"_one_{fk}"))
        df = df.join(side, F.col(fk) == F.col("_key"), "left").drop("_key")
        embedded.append(F.col(f"_one_{fk}").alias(fk))
    page = F.lit(0).cast("bigint")
    if many:
        name, target, fk = many
        children = tables[target].where(F.col(fk).isNotNull())
        children = children.select("pk", F.col(fk).alias("_parent"), resource(target, base).alias("_child"))
        # Keys alone are numbered; the rows join them where they are gathered.
        numbered = paged(children.select("pk", "_parent"), "_parent", "pk", page_size)
        pages = children.select("pk", "_child").join(numbered, "pk").groupBy("_parent", "page").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pk", "_child"))), lambda c: c["_child"]).alias("_children")
        )
        parents = children.select(F.col("_parent").alias("pk")).distinct()
        childless = tables[entity].select("pk").join(parents, "pk", "left_anti").select(
            F.col("pk").alias("_parent"), page.alias("page"),
            F.array().cast(pages.schema["_children"].dataType).alias("_children"),
        )
        # Pages look their parent up, so the many pages of one parent are the side that can be split.
        df = pages.unionByName(childless).join(df, F.col("pk") == F.col("_parent")).drop("_parent")
        page = F.col("page")
        embedded.append(F.col("_children").alias(name))
    return df.select("pk", page.alias("page"), F.col("_resource").alias("resource"), *embedded)


def _body(row: Column, fields: list[str]) -> Column:
    """JSON text of a resource up to its last brace: all fields, null ones too, and the links there are."""
    plain = F.to_json(F.struct(*[row.getField(c).alias(c) for c in fields if c != "_links"]), {"ignoreNullFields": "false"})
    return F.concat(F.rtrim(plain, F.lit("}")), F.lit(',"_links":'), F.to_json(row.getField("_links")))


def _whole(fields: list[str]) -> Callable[[Column], Column]:
    """JSON text of a resource without embedded rows."""
    return lambda row: F.concat(_body(row, fields), F.lit("}"))


def hal(tables: dict[str, DataFrame], entity: str, base: str, *, page_size: int = PAGE_SIZE) -> DataFrame:
    """Resource pages of a table as JSON text: pk, page, body. A null field is written, a null link or embedded row is not."""
    rows = embed_related(
        tables, entity, base, one=EMBED_ONE.get(entity), many=EMBED_MANY.get(entity), page_size=page_size
    )
    parts = []
    for name in rows.columns[3:]:
        kind = rows.schema[name].dataType
        if isinstance(kind, ArrayType):
            text = F.concat(F.lit("["), F.array_join(F.transform(name, _whole(kind.elementType.fieldNames())), ","), F.lit("]"))
        else:
            text = _whole(kind.fieldNames())(F.col(name))
        parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f'"{name}":'), text)))
    body = _body(F.col("resource"), rows.schema["resource"].dataType.fieldNames())
    if parts:
        held = F.array_join(F.array_compact(F.array(*parts)), ",")
        body = F.concat(body, F.when(held != "", F.concat(F.lit(',"_embedded":{'), held, F.lit("}"))).otherwise(""))
    return rows.select("pk", "page", F.concat(body, F.lit("}")).alias("body"))


def collection_items(payloads: DataFrame, *keys: str, payload: str = "payload") -> DataFrame:
    """Items of JSON payloads, an array or the first array or object found under ``_embedded``.

    Result: keys, position from 0, item (JSON text). A payload with neither has no items.
    """

    def items(text: Column) -> Column:
        as_array = F.from_json(text, "array<string>")
        return F.when(text.startswith("["), as_array).when(text.startswith("{"), F.array(text))

    text = F.trim(F.col(payload))
    values = F.map_values(F.from_json(F.get_json_object(text, "$._embedded"), "map<string,string>"))
    held = F.filter(values, lambda v: v.startswith("[") | v.startswith("{"))
    first = F.try_element_at(held, F.lit(1))
    found = F.when(text.startswith("["), items(text)).otherwise(items(first))
    return payloads.select(*keys, F.posexplode(found).alias("position", "item"))
