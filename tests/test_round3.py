"""Slugs, null fields, cascades and numbering beyond the simple cases."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from reelbook.functions import text as X
from reelbook.operators import changes, describe, numbering, quality
from reelbook.plans import nested
from reelbook.session import stage
from reelbook.sources import files
from tests.helpers import final_plan, rows, ts
from tests.test_rules import entities


def slug(text):
    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", folded)).strip("-_")


def test_slugs_equal_compatibility_folding_of_every_character(spark):
    points = [*range(0x10000)][: 0xD800] + [*range(0xE000, 0x10000)]
    df = spark.createDataFrame([(f"a{chr(p)}b",) for p in points if p] + [("ﬁnal ½ ™ Ⅳ café",), (None,), ("",)], "s string")
    for text, got, alone in df.select("s", X.slugify("s"), X.slugify(F.substring("s", 2, 1))).collect():
        assert got == (None if text is None else slug(text)), repr(text)
        assert alone == (None if text is None else slug(text[1:2])), repr(text)


def test_null_fields_are_written_and_null_links_are_not(spark):
    tables = entities(
        spark, cuts=[{"pk": 1, "name": 'a "}', "type_cut": None, "game": None}], teams=[{"pk": 2, "name": None, "logo": 3}, {"pk": 3, "logo": None}],
        team_logos=[{"pk": 3, "name": "l", "short_name": None}],
    )

    def body(entity):
        return {r["pk"]: json.loads(r["body"]) for r in nested.hal(tables, entity, "http://h").collect()}

    cut = body("cuts")[1]
    assert cut["name"] == 'a "}' and "type_cut" in cut and cut["type_cut"] is None and cut["slug"] is None and set(cut["_links"]) == {"self"}
    teams = body("teams")
    assert teams[2]["name"] is None and teams[2]["_embedded"]["logo"]["short_name"] is None and "_embedded" not in teams[3]
    logo = body("team_logos")[3]
    assert logo["short_name"] is None and logo["_embedded"]["teams"][0]["name"] is None and set(logo["_embedded"]["teams"][0]["_links"]) == {"self", "logo"}


def test_cascade_over_three_levels(spark):
    tables = entities(
        spark, tournaments=[{"pk": 1}, {"pk": 2}], games=[{"pk": 1, "tournament": 1, "team1": 5}, {"pk": 2, "tournament": 2, "team1": 5, "team2": 6}],
        cuts=[{"pk": 1, "game": 1}, {"pk": 2, "game": 2}, {"pk": 3, "game": None}], teams=[{"pk": 5}, {"pk": 6}],
        video_metadata=[{"pk": 1, "tournament": 1, "miniature_image": 7}, {"pk": 2, "tournament": 2, "base_image": 7, "miniature_image": 8}],
        tmp_images=[{"pk": 7, "image": "seven"}, {"pk": 8, "image": "eight"}], yt_videos=[{"pk": 1, "linked_video": 1}, {"pk": 2, "linked_video": 2}],
    )

    def keys(*pks):
        return spark.createDataFrame([(p,) for p in pks], "pk long")

    after, paths = changes.delete_cascade(tables, {"tournaments": keys(1, 99), "teams": keys(5), "video_metadata": keys(1)})
    assert rows(after["tournaments"], "pk") == [(2,)] and rows(after["games"], "pk", "team1", "team2") == [(2, None, 6)]
    assert rows(after["cuts"], "pk", "game") == [(1, None), (2, 2), (3, None)]
    assert rows(after["video_metadata"], "pk", "tournament", "base_image", "miniature_image") == [(2, 2, None, 8)]
    assert rows(after["yt_videos"], "pk", "linked_video") == [(1, None), (2, 2)]
    assert rows(after["tmp_images"], "pk") == [(8,)] and rows(paths) == [("seven",)]
    assert rows(quality.orphan_report(after)) == []


def test_cascade_and_report_read_tables_once_or_twice(spark):
    tables = entities(spark, video_metadata=[{"pk": 1, "base_image": 1, "miniature_image": 2, "team1": 4}], tmp_images=[{"pk": 1}, {"pk": 2}], team_logos=[{"pk": 4}])
    gone = changes.gone_keys(tables, {"tmp_images": spark.createDataFrame([(1,), (2,)], "pk long"), "team_logos": spark.createDataFrame([(4,)], "pk long")})
    one = changes.without_references(tables["video_metadata"], [("base_image", "tmp_images"), ("miniature_image", "tmp_images"), ("team1", "team_logos")], gone)
    text = final_plan(one)
    assert len(re.findall(r"\bJoin\b|HashJoin|MergeJoin", text)) == 2 and rows(one, "base_image", "miniature_image", "team1") == [(None, None, None)]
    assert len(re.findall(r"HashJoin|MergeJoin", final_plan(quality.orphan_report(tables)))) <= 1


def test_numbering_spreads_a_group_of_any_values(spark):
    """All values of a hot group lie in one second, those of a sparse group far apart."""
    rnd = random.Random(1)
    data = [("hot", rnd.random()) for _ in range(4000)] + [("sparse", i * 1e9) for i in range(50)] + [(None, 3.0), (None, None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.number_within(df, ["g"], "v")
        want = df.selectExpr("g", "v", "cast(row_number() over (partition by g order by v) as bigint) as position")
        assert rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    ranges = df.repartitionByRange(4, "g", "v").select("g", F.spark_partition_id().alias("r")).groupBy("r").count()
    assert max(r["count"] for r in ranges.collect()) < 2000


def test_a_recording_with_a_million_chapters(spark):
    """Text and lines agree, no part is longer than asked, and a start that is no number is counted."""
    details = spark.createDataFrame([(1, "A", "B", None, "", ""), (2, "C", "D", None, "", "")], "pk long, team1_name string, team2_name string, tournament_date date, tournament_tugeny_link string, tournament_JTR string")
    many = spark.range(1_000_000).select(F.lit(1).cast("long").alias("video"), (F.col("id") * 2).cast("string").alias("start_time"))
    few = spark.createDataFrame([(2, "5"), (2, "soon"), (2, "65.5")], "video long, start_time string")
    parts = stage(describe.description_parts(details, many.unionByName(few).withColumn("end_time", F.lit("")), size=1000), "parts")
    assert parts.where("pk = 1").agg(F.sum("n_lines"), F.max("n_lines"), F.count("*"), F.sum("unreadable")).first() == (1_000_007, 1000, 1001, 0)
    lines = parts.where("pk = 1 and part = 500").first()["text"].split("\n")
    first = 500 * 1000 - 7 + 1  # seven lines stand above the chapters
    assert lines == [f"{(n - 1) * 2 // 60:02}:{(n - 1) * 2 % 60:02} Point {n}" for n in range(first, first + 1000)]
    assert rows(parts.where("pk = 2"), "part", "n_lines", "unreadable") == [(0, 10, 1)]
    assert parts.where("pk = 2").first()["text"].split("\n")[-2:] == ["00:05 Point 2", "01:05 Point 3"]


def test_inventories_are_compared_by_path_length_and_time(spark):
    schema = "dir string, name string, length long, modificationTime timestamp_ntz"
    day, later = ts("2024-01-01"), ts("2024-01-02")
    known = spark.createDataFrame([("/a/", "same", 1, day), ("/a/", "longer", 1, day), ("/a/", "later", 1, day), ("/a/", "gone", 1, day), ("/b/", "x", None, None)], schema)
    listed = spark.createDataFrame([("/a/", "same", 1, day), ("/a/", "longer", 2, day), ("/a/", "later", 1, later), ("/b/", "gone", 1, day), ("/b/", "x", None, None)], schema)
    assert rows(files.inventory_changes(listed, known), "dir", "name", "status", "length") == [
        ("/a/", "gone", "gone", None), ("/a/", "later", "changed", 1), ("/a/", "longer", "changed", 2), ("/b/", "gone", "new", 1)]
    assert rows(files.inventory_changes(listed, listed)) == []
