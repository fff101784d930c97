"""Tables kept in buckets: only what is touched moves, and no reader sees half a change."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelbook.operators import changes
from reelbook.schemas import ENTITIES
from reelbook.sources import document_store, documents
from reelbook.streaming import upsert
from tests.helpers import rows, table, ts
from tests.test_rules import items, videos


def folders_of(snapshot):
    return {b: f for b, f in snapshot.folders.items()}


def some_videos(spark, n=60):
    return videos(spark, *[{"pk": i, "title": f"t{i}"} for i in range(1, n + 1)])


def test_upsert_in_buckets_equals_the_whole_table(spark, tmp_path):
    rnd = random.Random(4)
    yt = some_videos(spark)
    store = upsert.video_buckets(spark, str(tmp_path))
    snapshot = upsert.create_video_buckets(store, yt, 8)
    assert rows(store.read(snapshot)) == rows(yt)
    whole = yt
    for step in range(3):
        batch = items(spark, *[(0, i, f"v{rnd.randint(1, 70)}", rnd.choice(["t5", "x", "y"]), "2024-03-01", "public") for i in range(6)])
        before = snapshot
        touched = store.touched(before, batch)
        snapshot = upsert.upsert_buckets(store, before, batch)
        whole = spark.createDataFrame(changes.upsert_catalogue(whole, batch).collect(), ENTITIES["yt_videos"])
        assert rows(store.read(snapshot)) == rows(whole) and sum(snapshot.rows.values()) == whole.count()
        moved = {b for b, f in folders_of(snapshot).items() if f != before.folders[b]}
        assert moved == set(touched) and len(moved) < 8
    # Earlier snapshots stay readable, and the last one is found anew.
    assert rows(store.read(store.snapshot(0))) == rows(yt) and store.snapshot() == snapshot


def test_compaction_touches_buckets_of_new_items_only(spark, tmp_path):
    store = upsert.video_buckets(spark, str(tmp_path / "videos"))
    first = upsert.create_video_buckets(store, some_videos(spark), 16)
    one = items(spark, (0, 0, "v1", "renamed", "2024-03-01", "public")).withColumn("batch", F.lit(3).cast("long"))
    second = upsert.compact_into_buckets(store, first, one)
    assert second.properties["applied"] == 3 and sum(second.folders[b] != first.folders[b] for b in first.folders) == 1
    written = list((tmp_path / "videos" / "data" / second.folders[store.touched(first, one)[0]]).rglob("*.parquet"))
    assert len(written) == 1
    # The same log again changes nothing; a later batch applies on top.
    assert upsert.compact_into_buckets(store, second, one) is second
    later = one.unionByName(items(spark, (0, 0, "new", "n", "2024-03-02", "public")).withColumn("batch", F.lit(4).cast("long")))
    third = upsert.compact_into_buckets(store, second, later)
    assert rows(store.read(third).where("video_id in ('v1', 'new')"), "pk", "title") == [(1, "renamed"), (61, "n")]
    assert upsert.compact_into_buckets(store, second, later, through=3) is second


def test_only_asked_buckets_are_opened(spark, tmp_path):
    store = upsert.video_buckets(spark, str(tmp_path))
    snapshot = upsert.create_video_buckets(store, some_videos(spark), 16)
    bucket = store.touched(snapshot, spark.createDataFrame([("v7",)], "video_id string"))
    assert len(bucket) == 1 and len(store.read(snapshot, bucket).inputFiles()) == 1
    assert store.read(snapshot, []).count() == 0


def test_changes_are_whole_or_not_at_all(spark, tmp_path):
    store = upsert.video_buckets(spark, str(tmp_path))
    first = upsert.create_video_buckets(store, some_videos(spark), 4)
    row = store.read(first).where("video_id = 'v1'")
    home = store.touched(first, row)
    with pytest.raises(ValueError, match="twice"):
        store.replace(first, row.unionByName(row), home)
    with pytest.raises(ValueError, match="not to be replaced"):
        store.replace(first, row, [b for b in range(4) if b not in home][:1])
    assert store.snapshot() == first
    second = store.replace(first, row, home)
    # A second writer that began at the same snapshot is refused.
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.replace(first, row, home)
    assert store.snapshot() == second


def games(spark):
    return table(spark, "games", [{"pk": i, "name": str(i), "source_name": str(i), "json_file": f} for i, f in enumerate(["json_files/a b.json", "json_files/c+d.json", "json_files/é.json", "", None, "none.json"])])


def test_documents_are_found_and_replaced_by_game(spark, tmp_path):
    folder = tmp_path / "tree"
    (folder / "json_files").mkdir(parents=True)
    texts = {"json_files/a b.json": '{\n  "team1": "A",\n  "own": {"x": [1, 2]}\n}', "json_files/c+d.json": '{"team1": "C"}', "json_files/é.json": "no document"}
    for name, text in texts.items():
        (folder / name).write_text(text)
    store = document_store.document_store(spark, str(tmp_path / "store"))
    found = document_store.read_document_files(spark, str(folder))
    assert dict(map(tuple, found.collect())) == texts
    snapshot = document_store.create_documents(store, found, buckets=4)
    held = {r["pk"]: r["document"] for r in document_store.documents_of_games(store, snapshot, games(spark)).collect()}
    assert held == {0: texts["json_files/a b.json"], 1: texts["json_files/c+d.json"], 2: "no document", 3: None, 4: None, 5: None}
    new = json.dumps({"team1": "B", "cuts": [{"at": 1.5}], "unknown": None})
    after = document_store.set_documents_of_games(store, snapshot, games(spark), spark.createDataFrame([(0, new), (5, "{}")], "pk long, document string"))
    held = {r["pk"]: r["document"] for r in document_store.documents_of_games(store, after, games(spark).where("pk in (0, 1, 5)")).collect()}
    assert held == {0: new, 1: texts["json_files/c+d.json"], 5: "{}"}
    got = document_store.parsed(store.read(after))
    assert rows(got, "json_file", "team1") == sorted([("json_files/a b.json", "B"), ("json_files/c+d.json", "C"), ("json_files/é.json", None), ("none.json", None)], key=str)


def test_refused_document_changes(spark, tmp_path):
    store = document_store.document_store(spark, str(tmp_path))
    snapshot = document_store.create_documents(store, spark.createDataFrame([("a.json", "{}")], "json_file string, document string"), buckets=2)
    twice = spark.createDataFrame([("a.json", "1"), ("a.json", "2")], "json_file string, document string")
    with pytest.raises(Exception, match="twice"):
        document_store.set_documents(store, snapshot, twice)
    with pytest.raises(Exception, match="a document is missing"):
        document_store.set_documents(store, snapshot, spark.createDataFrame([("a.json", None)], "json_file string, document string"))
    with pytest.raises(Exception, match="no document of game 4"):
        document_store.set_documents_of_games(store, snapshot, games(spark), spark.createDataFrame([(4, "{}")], "pk long, document string"))
    assert store.snapshot() == snapshot


def test_lines_carry_the_name_of_their_document(spark, tmp_path):
    none = F.array().cast("array<string>")
    docs = spark.createDataFrame([("x/a.json",), ("x/b.json",)], "json_file string").withColumn("document", documents.initial_edit_document(F.lit("/d"), none, F.col("json_file")))
    documents.write_edit_documents(docs, str(tmp_path / "lines"), name="json_file")
    assert rows(documents.read_edit_documents(spark, str(tmp_path / "lines")), "json_file", "filename") == [("x/a.json", "x/a.json"), ("x/b.json", "x/b.json")]


def test_two_edits_or_probes_of_a_recording_fail(spark):
    rec = table(spark, "video_metadata", [{"pk": 1, "name": "a.mp4", "tournament": 1, "team1": 1, "team2": 1}])
    tournaments, logos = table(spark, "tournaments", [{"pk": 1, "name": "T"}]), table(spark, "team_logos", [{"pk": 1, "name": "A", "short_name": "a"}])
    edits = spark.createDataFrame([(1, "0.5", None, None, None, None, None)] * 2,
                                  "pk long, miniature_x_offset string, miniature_y_offset string, miniature_zoom string, time_code string, team1 long, team2 long")
    probes = spark.createDataFrame([(1, []), (1, [])], "video long, chapters array<struct<start_time: string, end_time: string>>")
    with pytest.raises(Exception, match="several changes of pk 1"):
        changes.apply_crop_edit(rec, edits, tournaments, logos, probes.limit(1)).collect()
    with pytest.raises(Exception, match="several changes of video 1"):
        changes.reset_metadata(rec, tournaments, logos, probes).collect()
    with pytest.raises(Exception, match="several changes of video 1"):
        changes.apply_crop_edit(rec, edits.limit(1), tournaments, logos, probes).collect()
    named = probes.select(F.lit("n.mp4").alias("name"), F.lit(1).cast("long").alias("tournament"), "chapters")
    files = spark.createDataFrame([("n.mp4", 1)], "name string, tournament long")
    with pytest.raises(Exception, match="several changes of _file"):
        changes.create_recordings(files, rec, tournaments, logos, named, F.lit(ts("2024-01-01"))).collect()
