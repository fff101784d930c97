"""New rows: defaults, refusals, unique columns, keys."""

from reelbook.operators.insert import insert_rows
from tests.helpers import rows, table, ts

NOW = ts("2024-03-04T05:06:07")


def test_defaults_and_refusals_of_recordings(spark):
    old = table(spark, "video_metadata", [{"pk": 5, "name": "a.mp4", "tournament": 1}])
    new = spark.createDataFrame(
        [(1, "a.mp4", 1), (2, "a.mp4", None), (3, "a.mp4", None), (4, None, 1), (5, "b" * 101, 1), (6, "c.mp4", 1), (7, "c.mp4", 1)],
        "at long, name string, tournament long",
    )
    after, refused = insert_rows(old, new, "video_metadata", order="at", as_of=NOW)
    assert after.schema.names == old.schema.names
    assert rows(refused, "at", "reasons") == [
        (1, ["name, tournament not unique"]), (4, ["name required"]), (5, ["name too long"]), (7, ["name, tournament not unique"]),
    ]
    added = after.where("pk > 5")
    assert sorted(r["pk"] for r in added.collect()) == [6, 7, 8]
    assert rows(added.select("miniature_zoom", "time_code", "video_name", "description", "publication_date", "team1").distinct()) == [(1.0, 0.0, "", "", NOW, None)]


def test_a_refused_row_takes_nothing(spark):
    old = table(spark, "yt_videos", [])
    new = spark.createDataFrame([(1, "v", "t" * 151), (2, "v", None)], "at long, video_id string, title string")
    after, refused = insert_rows(old, new, "yt_videos", order="at", as_of=NOW)
    assert rows(after) == [(1, "", "v", None, ts("2024-03-04T00:00:00"), "")]
    assert rows(refused) == [(1, ["title too long"])]
    assert insert_rows(old, new.where("false"), "yt_videos", order="at", as_of=NOW)[0].count() == 0


def test_unknown_choice(spark):
    new = spark.createDataFrame([(1, "x", "BAD"), (2, "y", "MAN")], "at long, name string, type_cut string")
    after, refused = insert_rows(table(spark, "cuts", []), new, "cuts", order="at", as_of=NOW)
    assert rows(after, "pk", "json_file", "slug") == [(1, "tt", "")] and rows(refused) == [(1, ["type_cut unknown"])]
