"""Time the headline queries and print one JSON line.

The catalogue tables are derived from the given ones and stored as Parquet first, untimed, as a
catalogue is kept. Each query then reads them, runs whole and discards its result, twice: ``cold`` holds
the first runs, ``queries`` the second.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

import workload.queries  # noqa: F401
from workload.fixtures import Tables
from workload.registry import BUILDERS

HEADLINE = [
    "identify_teams", "relink_videos", "relink_videos_one_tournament", "link_exact", "claim_unlinked", "tournament_games_view",
    "tournaments_view", "publish_status_per_video", "ingest_catalogue_pages", "upsert_catalogue", "stream_catalogue_upsert",
    "sync_recordings", "sync_recordings_links", "reset_metadata", "apply_patch", "apply_crop_edit", "group_recording_parts",
    "generate_games", "number_chapters", "description_text", "plan_thumbnails", "delete_cascade", "purge_images", "orphan_report",
    "validate_entities", "embed_related", "hal_video_metadata", "hal_tournaments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    shared = tempfile.mkdtemp(prefix="bench-")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder).store()
    rounds: list[dict[str, float]] = [{}, {}]
    for times in rounds:
        for name in HEADLINE:
            start = time.perf_counter()
            BUILDERS[name](tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    cold, times = rounds
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
