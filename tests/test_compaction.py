"""Compacted snapshots of the streamed catalogue."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reelbook.streaming import upsert
from tests.helpers import table, ts


def log_of(spark, *items):
    schema = "page_no long, item_pos int, video_id string, title string, description string, date timestamp_ntz, status string, batch long"
    return spark.createDataFrame([(0, i, v, t, "", ts("2024-01-01"), "public", b) for i, (b, v, t) in enumerate(items)], schema)


def titles(df):
    return {r["video_id"]: r["title"] for r in df.collect()}


def test_later_edit_survives_compaction_and_replay(spark, tmp_path):
    base = table(spark, "yt_videos", [{"pk": 1, "video_id": "a", "title": "old"}])
    log = log_of(spark, (0, "a", "logged"), (1, "b", "new"))
    assert upsert.compact_log(base, log, f"{tmp_path}/one") == 1
    kept, applied = upsert.read_snapshot(spark, f"{tmp_path}/one")
    assert titles(kept) == {"a": "logged", "b": "new"} and applied == 1
    edited = kept.withColumn("title", F.when(F.col("video_id") == "a", "by hand").otherwise(F.col("title")))
    upsert.write_snapshot(edited, applied, f"{tmp_path}/two")
    edited, applied = upsert.read_snapshot(spark, f"{tmp_path}/two")
    # The same batches written again change nothing; a later one does.
    assert titles(upsert.current_videos(edited, log, after=applied)) == {"a": "by hand", "b": "new"}
    more = log.unionByName(log_of(spark, (2, "b", "newer")))
    assert upsert.compact_log(edited, more, f"{tmp_path}/three", after=applied) == 2
    assert titles(upsert.read_snapshot(spark, f"{tmp_path}/three")[0]) == {"a": "by hand", "b": "newer"}
    assert upsert.compact_log(base, more, f"{tmp_path}/four", through=0) == 0
    assert titles(upsert.read_snapshot(spark, f"{tmp_path}/four")[0]) == {"a": "logged"}
    edited.write.parquet(f"{tmp_path}/half/videos")
    with pytest.raises(AnalysisException):
        upsert.read_snapshot(spark, f"{tmp_path}/half")
