"""Which thumbnails are stale, and everything needed to render them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.functions import crop
from reelbook.functions import text as X
from reelbook.operators.describe import require_teams_and_tournament
from reelbook.operators.joins import lookup, recording_details


def publish_thumbnails(recordings: DataFrame, yt_videos: DataFrame, tmp_images: DataFrame) -> DataFrame:
    """Which thumbnail goes to which online video: pk, video_id, path, problem.

    A recording's first online video takes its thumbnail image; ``problem`` tells what a recording lacks, else it is null.
    """
    linked = yt_videos.where(F.col("linked_video").isNotNull())
    first = linked.groupBy("linked_video").agg(F.min_by("video_id", "pk").alias("video_id"))
    df = lookup(recordings.select("pk", "miniature_image"), first, "pk", {"video_id": "video_id"}, key="linked_video")
    df = lookup(df, tmp_images, "miniature_image", {"path": "image"})
    problem = F.when(F.col("video_id").isNull(), "no online video").when(F.col("path").isNull(), "no thumbnail")
    return df.select("pk", "video_id", "path", problem.alias("problem"))


def plan_thumbnails(tables: dict[str, DataFrame], media: DataFrame, logo_sizes: DataFrame,
                    title_sizes: DataFrame) -> DataFrame:
    """Render plan of every recording whose frame or thumbnail image is missing or named otherwise.

    ``media`` has (pk, duration, width, height) per recording, ``logo_sizes`` (pk, width, height) per
    logo, ``title_sizes`` (pk, width) per tournament. Crop values out of range make no plan.
    """
    # Sizes join the logos and tournaments they belong to, not every recording.
    logos = lookup(tables["team_logos"], logo_sizes, "pk", {"width": "width", "height": "height"})
    tournaments = lookup(tables["tournaments"], title_sizes, "pk", {"title_width": "width"})
    details = recording_details(
        tables["video_metadata"], tournaments, logos, tables["tmp_images"],
        team_columns=["width", "height"], tournament_columns=["title_width"],
    )
    ready, _ = require_teams_and_tournament(details)
    valid = (
        F.col("miniature_zoom").between(C.ZOOM_MIN, C.ZOOM_MAX)
        & F.col("miniature_x_offset").between(0.0, 1.0)
        & F.col("miniature_y_offset").between(0.0, 1.0)
    )
    key = X.thumbnail_key("tournament_slug", "name", "time_code")
    named = ready.where(valid).select(
        "*",
        F.concat(key, F.lit("_base.jpeg")).alias("base_target"),
        F.concat(key, F.lit("_thumbnail.jpeg")).alias("thumbnail_target"),
    )
    decode = ~F.col("base_image_name").eqNullSafe(F.col("base_target"))
    stale = named.withColumn("decode_frame", decode).where(
        F.col("decode_frame") | ~F.col("miniature_name").eqNullSafe(F.col("thumbnail_target"))
    )
    sized = lookup(stale, media, "pk", {"_duration": "duration", "_media_width": "width", "_media_height": "height"})
    # A decoded frame is scaled to the full width before it is stored or cropped.
    scaled = F.floor(F.lit(C.FRAME_WIDTH) * F.col("_media_height") / F.col("_media_width")).cast("int")
    df = sized.withColumns({"_width": F.when(F.col("_media_width").isNotNull(), F.lit(C.FRAME_WIDTH)), "_height": scaled})
    return df.select(
        "pk",
        X.rendered_path("tournament_dir", "name").alias("source"),
        "decode_frame",
        crop.frame_second("_duration", "time_code").alias("frame_second"),
        F.struct(F.col("_width").alias("width"), F.col("_height").alias("height")).alias("frame"),
        crop.aspect_crop("_width", "_height").alias("aspect"),
        crop.crop_window("miniature_x_offset", "miniature_y_offset", "miniature_zoom").alias("window"),
        crop.logo_box("team1_width", "team1_height", C.LOGO1_CENTRE).alias("logo1"),
        crop.logo_box("team2_width", "team2_height", C.LOGO2_CENTRE).alias("logo2"),
        F.col("team1_image").alias("logo1_image"),
        F.col("team2_image").alias("logo2_image"),
        crop.title_pos("tournament_title_width").alias("title"),
        F.upper("tournament_name").alias("title_text"),
        F.col("tournament_color").alias("color"),
        "base_target",
        "thumbnail_target",
    )
