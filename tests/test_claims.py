"""All claims against asking for one recording after the other."""

import random

import pytest
from pyspark.sql import functions as F

from reelbook.operators import claims
from tests.helpers import table, ts


def one_by_one(videos, recordings):
    linked = {pk: link for pk, _, link in videos}
    for pk, name, title in sorted(recordings):
        wanted = ((name or "").split(".")[0], title or "")
        found = [v for v, t, _ in videos if linked[v] is None and t is not None and t in wanted]
        if found:
            linked[min(found)] = pk
    return linked


def claimed(spark, videos, recordings):
    yt = table(spark, "yt_videos", [{"pk": pk, "title": t, "linked_video": link, "video_id": f"v{pk}", "publication_date": ts("2024-01-01")} for pk, t, link in videos])
    rec = table(spark, "video_metadata", [{"pk": pk, "name": n, "video_name": t, "tournament": 1} for pk, n, t in recordings])
    return {r["pk"]: r["linked_video"] for r in claims.claim_all(yt, rec).collect()}


def random_case(seed):
    rnd = random.Random(seed)
    titles = [*"abcdefgh"[: rnd.randint(2, 8)], "", None]
    videos = [(i, rnd.choice(titles), 999 if rnd.random() < 0.1 else None) for i in rnd.sample(range(200), rnd.randint(5, 60))]
    recordings = [(i, rnd.choice([None, "", ".mp4", *(f"{t}.x.mp4" for t in titles if t), "zz"]), rnd.choice([*titles, "yy"])) for i in rnd.sample(range(300), rnd.randint(5, 70))]
    return videos, recordings


@pytest.mark.parametrize("seed, walked", [(1, 100_000), (2, 100_000), (3, 4), (4, 0)])
def test_claims_equal_asking_one_by_one(spark, monkeypatch, seed, walked):
    monkeypatch.setattr(claims, "WALKED", max(walked, 1))
    if not walked:  # bounds alone
        monkeypatch.setattr(claims, "SETTLED_SHARE", -1.0)
        monkeypatch.setattr(claims, "WALKED", -1)
    videos, recordings = random_case(seed)
    assert claimed(spark, videos, recordings) == one_by_one(videos, recordings)


def test_recordings_and_videos_of_one_title_pair_up(spark):
    videos = [(i, "final", None) for i in (7, 3, 5)]
    assert claimed(spark, videos, [(2, "final.mp4", "x"), (1, "y.mp4", "final")]) == {3: 1, 5: 2, 7: None}
    assert claimed(spark, videos, []) == {3: None, 5: None, 7: None}
    assert claimed(spark, [], [(1, "a", "b")]) == {}


def test_a_hot_title_needs_no_round_per_row(spark, monkeypatch):
    """A third of the recordings share a title and have one of their own."""
    monkeypatch.setattr(claims, "WALKED", 10)
    rounds = []
    bounds = claims._bounds
    monkeypatch.setattr(claims, "_bounds", lambda *a: rounds.append(1) or bounds(*a))
    rnd = random.Random(9)
    recordings = [(i, f"own{i}.mp4", "hot" if i % 3 == 0 else f"t{i}") for i in range(900)]
    keys = rnd.sample(range(10_000), 900)
    videos = [(keys[i], "hot" if i < 250 else f"own{i}" if i < 600 else f"t{i}", None) for i in range(900)]
    assert claimed(spark, videos, recordings) == one_by_one(videos, recordings)
    assert len(rounds) <= 20


def test_plan_reads_no_queue_whole_in_one_task(spark):
    videos = [(i, "hot", None) for i in range(400)]
    yt = table(spark, "yt_videos", [{"pk": pk, "title": t, "video_id": f"v{pk}", "publication_date": ts("2024-01-01")} for pk, t, _ in videos])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = claims.sums_before(yt.select("title", "pk"), ["title"], ["pk"], {"place": F.lit(1)}, "test")
        assert sorted(r["place"] for r in placed.collect()) == list(range(400))
        assert placed.select(F.col("place")).count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
