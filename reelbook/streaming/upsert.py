"""Catalogue sync from a stream of landed pages.

A batch only writes its own normalised items, into a folder named by its number; replaying a batch
writes the same folder again. The online videos are the base snapshot with that log applied in
order, by the same upsert as the batch job, so their cost is paid when they are read or compacted,
not once per batch. A compacted snapshot keeps the number of the last batch it holds, and only later
batches apply to it. Log, snapshots and the checkpoint that numbers the batches belong together.

Kept in buckets of the video id, the online videos need not be read or written whole: a sync or a compaction opens the buckets its
items fall in and leaves the others where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelbook.operators.changes import apply_settled, settled_items, upsert_catalogue
from reelbook.schemas import CATALOGUE_PAGE, ENTITIES
from reelbook.session import stage
from reelbook.sources.buckets import BucketTable, Snapshot
from reelbook.sources.catalogue import catalogue_items


def read_page_stream(spark: SparkSession, folder: str, *, max_files: int | None = None) -> DataFrame:
    """Landed pages as a stream, oldest file first."""
    reader = spark.readStream.schema(CATALOGUE_PAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.json(folder)


def stream_catalogue_upsert(pages: DataFrame, log: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Start writing the item log of a page stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        catalogue_items(batch).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Items of all batches with the number of their batch."""
    schema = "page_no long, item_pos int, video_id string, title string, description string, date timestamp_ntz, status string, batch long"
    return spark.read.schema(schema).parquet(log)


def current_videos(yt_videos: DataFrame, log: DataFrame, *, update_on: str = "title", after: int | None = None) -> DataFrame:
    """The online videos after every logged batch, or every one later than ``after``, the last ``yt_videos`` holds."""
    if after is not None:
        log = log.where(F.col("batch") > after)
    return upsert_catalogue(yt_videos, log, order=["batch", "page_no", "item_pos"], update_on=update_on)


def write_snapshot(yt_videos: DataFrame, applied: int, folder: str) -> None:
    """Write online videos and the last batch they hold to a new folder; without the latter, written last, it is not read."""
    yt_videos.write.parquet(f"{folder}/videos")
    yt_videos.sparkSession.range(1).select(F.lit(applied).cast("bigint").alias("batch")).write.parquet(f"{folder}/applied")


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Online videos of a snapshot and the last batch they hold, to be given to :func:`current_videos` as ``after``."""
    applied = spark.read.schema("batch long").parquet(f"{folder}/applied").first()["batch"]
    return spark.read.schema(ENTITIES["yt_videos"]).parquet(f"{folder}/videos"), applied


def compact_log(yt_videos: DataFrame, log: DataFrame, folder: str, *, update_on: str = "title", after: int | None = None, through: int | None = None) -> int:
    """Write the online videos after the logged batches as a snapshot in a new folder; the last batch it holds.

    ``after`` is the last batch ``yt_videos`` holds already. While the stream runs, ``through`` names the last finished batch.
    """
    if through is not None:
        log = log.where(F.col("batch") <= through)
    last = log.agg(F.max("batch")).first()[0]
    applied = max((x for x in (last, after, through) if x is not None), default=-1)
    write_snapshot(current_videos(yt_videos, log, update_on=update_on, after=after), applied, folder)
    return applied


# Online videos in buckets -----------------------------------------------------------------------------------------------


def video_buckets(spark: SparkSession, root: str) -> BucketTable:
    """The online videos kept under a folder by the hash of their id."""
    return BucketTable(spark, root, ENTITIES["yt_videos"], "video_id")


def create_video_buckets(table: BucketTable, yt_videos: DataFrame, buckets: int, *, applied: int = -1) -> Snapshot:
    """First snapshot. It knows the highest key in use and the last batch it holds."""
    return table.create(yt_videos, buckets, last_pk=yt_videos.agg(F.coalesce(F.max("pk"), F.lit(0))).first()[0], applied=applied)


def upsert_buckets(table: BucketTable, snapshot: Snapshot, items: DataFrame, *, order: tuple[str, ...] = ("page_no", "item_pos"),
                   update_on: str = "title", **properties) -> Snapshot:
    """The snapshot after a catalogue sync, equal to the upsert of the whole table. Only buckets an item falls in are read and written."""
    settled = settled_items(items, order=order, update_on=update_on)
    buckets = table.touched(snapshot, settled)
    if not buckets:
        return table.replace(snapshot, table.read(snapshot, []), [], **properties) if properties else snapshot
    last = snapshot.properties["last_pk"]
    after = stage(apply_settled(table.read(snapshot, buckets), settled, F.lit(last).cast("bigint")), "upsert")
    highest = max(last, after.agg(F.max("pk")).first()[0])
    return table.replace(snapshot, after, buckets, last_pk=highest, **properties)


def compact_into_buckets(table: BucketTable, snapshot: Snapshot, log: DataFrame, *, through: int | None = None, update_on: str = "title") -> Snapshot:
    """The snapshot after the batches of the log it does not hold yet, up to ``through`` if given."""
    log = log.where(F.col("batch") > snapshot.properties["applied"])
    if through is not None:
        log = log.where(F.col("batch") <= through)
    last = log.agg(F.max("batch")).first()[0]
    if last is None:
        return snapshot
    return upsert_buckets(table, snapshot, log, order=("batch", "page_no", "item_pos"), update_on=update_on, applied=last)
