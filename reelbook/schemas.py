"""Declared schemas of the eight catalogue tables and of the nested inputs."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "str": T.StringType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "int": T.IntegerType(),
    "bool": T.BooleanType(),
}


def _struct(spec: str) -> T.StructType:
    """Build a schema from ``name:type`` words."""
    fields = (word.split(":") for word in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


ENTITIES: dict[str, T.StructType] = {
    "tournaments": _struct(
        "pk:long name:str short_name:str date:date place:str JTR:str tugeny_link:str color:str source_dir:str slug:str"
    ),
    "teams": _struct("pk:long name:str logo:long slug:str"),
    "games": _struct(
        "pk:long name:str source_name:str tournament:long team1:long team2:long rendered:str json_file:str"
        " source_proxy:str slug:str"
    ),
    "cuts": _struct("pk:long name:str type_cut:str json_file:str slug:str game:long"),
    "team_logos": _struct("pk:long name:str short_name:str image:str"),
    "tmp_images": _struct("pk:long name:str date:date image:str"),
    "video_metadata": _struct(
        "pk:long name:str tournament:long time_code:double miniature_x_offset:double miniature_y_offset:double"
        " miniature_zoom:double base_image:long miniature_image:long team1:long team2:long video_name:str"
        " description:str publication_date:ts"
    ),
    "yt_videos": _struct(
        "pk:long title:str video_id:str linked_video:long publication_date:ts privacy_status:str"
    ),
}

#: One online item, normalised.
CATALOGUE_ITEM = _struct("video_id:str title:str description:str date:ts status:str")

#: One landed page of the online catalogue.
CATALOGUE_PAGE = T.StructType([
    T.StructField("page_no", T.LongType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("snippet", T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("publishedAt", T.StringType()),
            T.StructField("resourceId", _struct("videoId:str")),
        ])),
        T.StructField("status", _struct("privacyStatus:str publishAt:str")),
    ]))),
])

CHAPTERS = T.ArrayType(_struct("start_time:str end_time:str"))

#: Output of a chapter probe, with the file it was made from.
CHAPTER_PROBE = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("chapters", CHAPTERS),
])

#: Edit document of one game. Entries of cuts and Warnings stay raw JSON.
EDIT_DOCUMENT = T.StructType([
    T.StructField("team1", T.StringType()),
    T.StructField("team2", T.StringType()),
    T.StructField("dir", T.StringType()),
    T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("filename", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("training", T.BooleanType()),
    T.StructField("labeled", T.BooleanType()),
    T.StructField("rendered_file", T.BooleanType()),
    T.StructField("game_mode", T.StringType()),
    T.StructField("cuts", T.ArrayType(T.StringType())),
    T.StructField("Warnings", T.ArrayType(T.StringType())),
])
