"""Cases of the second round: equal chapters, fine time codes, fractions of a second, undated recordings, doubled changes."""

import pytest

from reelbook.functions import text as X
from reelbook.operators import changes, counts, describe, linking
from tests.helpers import rows, table, ts


def test_equal_chapters_each_have_a_number(spark):
    chapters = spark.createDataFrame([(1, "5", "9"), (1, "5", "9"), (1, "70", "90"), (1, "x", "y")], "video long, start_time string, end_time string")
    good = chapters.join(describe.unreadable_chapters(chapters), ["video", "start_time", "end_time"], "left_anti")
    assert [len(r["chapters"]) for r in describe.chapter_probes(good).collect()] == [3]
    assert rows(describe.number_chapters(good), "position") == [(1,), (2,), (3,)]
    assert rows(describe.unreadable_chapters(chapters), "start_time") == [("x",)]


def test_close_time_codes_have_keys_of_their_own(spark):
    df = spark.createDataFrame([("cup", "a.mp4", 0.12341), ("cup", "a.mp4", 0.12349)], "slug string, name string, t double")
    assert rows(df.select(X.thumbnail_key("slug", "name", "t"))) == [("cup_a_0.12341",), ("cup_a_0.12349",)]


def test_fractions_of_a_second_are_kept(spark):
    df = spark.createDataFrame([(ts("2024-01-02T03:04:05"),), (ts("2024-01-02T03:04:05.000120"),)], "t timestamp_ntz")
    assert rows(df.select(X.iso_utc("t"))) == [("2024-01-02T03:04:05.000120Z",), ("2024-01-02T03:04:05Z",)]


def test_undated_recordings_come_behind_dated_ones(spark):
    recordings = table(spark, "video_metadata", [
        {"pk": 1, "name": "final x.mp4", "video_name": ""}, {"pk": 2, "name": "final y.mp4", "video_name": "", "publication_date": ts("2024-01-01T00:00:00")},
    ])
    videos = table(spark, "yt_videos", [{"pk": 7, "title": "final"}])
    assert rows(linking.relink_videos(videos, recordings, latest=True)) == [(7, 2)]


def test_last_team_choice_by_name(spark):
    choices = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c")], "url string, name string")
    assert rows(counts.team_index(choices)) == [("u", "b"), ("v", "c")]


def test_two_changes_of_a_row_fail(spark):
    teams = table(spark, "teams", [{"pk": 1, "name": "a"}])
    twice = spark.createDataFrame([(1, "b"), (1, "c")], "pk long, name string")
    with pytest.raises(Exception, match="several changes of pk 1"):
        changes.apply_patch(teams, twice, ["name"]).collect()
    videos = table(spark, "yt_videos", [{"pk": 1, "video_id": "v"}])
    answers = spark.createDataFrame([("v", "b", None, "public"), ("v", "c", None, "public")], "video_id string, title string, date timestamp_ntz, status string")
    with pytest.raises(Exception, match="several changes of video_id v"):
        changes.apply_publish_response(videos, answers).collect()
