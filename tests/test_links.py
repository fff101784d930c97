"""Kept links against linking everything anew."""

import random

import pytest
from pyspark.sql import functions as F

from reelbook.operators import linking, links
from reelbook.plans.sync import FolderSync
from reelbook.session import new_folder, stage
from tests.helpers import final_plan, rows
from tests.test_rules import recordings, videos


def word(rnd, longest):
    return "".join(rnd.choice("ab C") for _ in range(rnd.randint(0, longest)))


@pytest.mark.parametrize("seed", range(2))
def test_kept_links_equal_linking_anew(spark, seed):
    rnd = random.Random(seed)
    rec = {i: (word(rnd, 20), word(rnd, 20)) for i in range(10, 30)}
    yt = {i: word(rnd, 4) if rnd.random() < 0.9 else None for i in range(40)}

    def tables():
        return videos(spark, *[{"pk": i, "title": t} for i, t in yt.items()]), recordings(spark, *[{"pk": i, "name": n, "video_name": v} for i, (n, v) in rec.items()])

    y, r = tables()
    kept = stage(links.title_links(y, r), "test")
    for step in ["add", "titles", "delete", "rename", "add low"]:
        if step.startswith("add"):
            new = {i: (word(rnd, 20), None if i % 3 == 0 else word(rnd, 20)) for i in (range(30, 36) if step == "add" else range(1, 5))}
            rec |= new
            y, r = tables()
            kept = links.with_recordings(kept, r.where(F.col("pk").isin(*new)))
        elif step == "titles":
            yt |= {i: word(rnd, 5) for i in range(30, 60)}
            y, r = tables()
            kept = links.with_titles(kept, y, r)
        elif step == "delete":
            gone = rnd.sample(sorted(rec), 8)
            rec = {k: v for k, v in rec.items() if k not in gone}
            y, r = tables()
            kept = links.without_recordings(kept, spark.createDataFrame([(i,) for i in gone], "pk long"), r)
        else:
            moved = rnd.sample(sorted(rec), 6)
            rec |= {i: (word(rnd, 20), word(rnd, 20)) for i in moved}
            y, r = tables()
            kept = links.with_renamed(kept, r.where(F.col("pk").isin(*moved)), r)
        kept = stage(kept, "test")
        assert rows(links.apply_links(y, kept), "pk", "linked_video") == rows(linking.relink_videos(y, r), "pk", "linked_video"), step
    assert rows(links.without_titles(kept, y)) == rows(links.title_links(y, r))


def test_links_of_nothing(spark):
    y, r = videos(spark, {"pk": 1, "title": ""}, {"pk": 2, "title": "x", "linked_video": 7}), recordings(spark)
    kept = links.title_links(y, r)
    assert rows(kept) == [("", None), ("x", None)]
    assert rows(links.with_recordings(kept, r)) == [("", None), ("x", None)]
    assert rows(links.apply_links(y, kept, scope="matched"), "pk", "linked_video") == [(1, None), (2, 7)]
    one = recordings(spark, {"pk": 3, "name": "b", "video_name": "X1"})
    assert rows(links.with_recordings(kept, one)) == [("", 3), ("x", 3)]
    with pytest.raises(ValueError):
        links.apply_links(y, kept, scope="none")


def test_a_sync_reads_no_old_name(spark):
    y, old = videos(spark, {"pk": 1, "title": "cup"}, {"pk": 2, "title": "old"}), recordings(spark, {"pk": 1, "name": "old cup", "video_name": "z"})
    folder = new_folder(spark, "recordings")
    old.write.parquet(folder)
    stored = spark.read.schema(old.schema).parquet(folder)
    kept = stage(links.title_links(y, stored), "test")
    created = recordings(spark, {"pk": 5, "name": "the cup", "video_name": "old"})
    done = FolderSync(stored.unionByName(created), created, lambda v: v)
    linked, after = done.relink_kept(y, kept)
    text = final_plan(linked) + final_plan(links.with_recordings(kept, created))
    assert folder not in text and "NestedLoop" not in text
    assert rows(linked, "pk", "linked_video") == [(1, 1), (2, 1)] and rows(after) == [("cup", 1), ("old", 1)]
