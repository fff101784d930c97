"""Landed pages of the online catalogue, and publish bodies for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbook import constants as C
from reelbook.functions import text as X
from reelbook.schemas import CATALOGUE_PAGE


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed page documents, one JSON object per line."""
    return spark.read.schema(CATALOGUE_PAGE).json(folder)


def catalogue_items(pages: DataFrame, *, from_date: Column | None = None) -> DataFrame:
    """One normalised row per item of every page, with its place (page_no, item_pos).

    ``from_date`` keeps items from that time on; without it every item is kept.
    """
    item = F.col("item")
    rows = pages.select("page_no", F.posexplode("items").alias("item_pos", "item")).select(
        "page_no",
        "item_pos",
        X.item_video_id(item["kind"], item["id"], item["snippet"]["resourceId"]["videoId"]).alias("video_id"),
        item["snippet"]["title"].alias("title"),
        item["snippet"]["description"].alias("description"),
        X.effective_date(item["status"]["publishAt"], item["snippet"]["publishedAt"]).alias("date"),
        item["status"]["privacyStatus"].alias("status"),
    )
    return rows if from_date is None else catalogue_since(rows, from_date)


def catalogue_since(items: DataFrame, from_date: Column | None = None) -> DataFrame:
    """Items dated ``from_date`` or later; by default from the first season on."""
    start = F.lit(C.CATALOGUE_START).cast("timestamp_ntz") if from_date is None else from_date
    return items.where(F.col("date") >= start)


def ingest_catalogue_pages(spark: SparkSession, folder: str, *, from_date: Column | None = None) -> DataFrame:
    """Read landed pages and normalise their items."""
    return catalogue_items(read_pages(spark, folder), from_date=from_date)


def publish_payloads(yt_videos: DataFrame, recordings: DataFrame, as_of: Column) -> DataFrame:
    """Update body per linked online video: video_id, body (JSON text).

    Title, description and date come from the recording, the status from the online video.
    """
    linked = yt_videos.join(
        recordings.select(
            F.col("pk").alias("linked_video"),
            F.col("video_name"),
            F.col("description"),
            F.col("publication_date").alias("_date"),
        ),
        "linked_video",
    )
    snippet = F.struct(
        F.col("video_name").alias("title"),
        F.col("description"),
        F.array(*map(F.lit, C.PUBLISH_TAGS)).alias("tags"),
        F.lit(C.PUBLISH_CATEGORY).alias("categoryId"),
        F.lit(False).alias("kids"),
    )
    schedule = X.publish_schedule("privacy_status", "_date", as_of)
    fields = F.coalesce(
        schedule,
        F.struct(F.lit(None).cast("string").alias("privacyStatus"), F.lit(None).cast("string").alias("publishAt")),
    )
    body = F.struct(F.col("video_id").alias("id"), snippet.alias("snippet"), fields.alias("status"))
    return linked.select("video_id", F.to_json(body).alias("body"))


def write_publish_payloads(payloads: DataFrame, folder: str) -> None:
    """Write the bodies as JSON lines."""
    payloads.select(F.col("body").alias("value")).write.text(folder)
