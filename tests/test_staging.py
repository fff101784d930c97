"""Staged folders have an owner that can drop them."""

import os

import pytest

from reelbook.session import drop_staged, new_folder, stage, staging


def folder_of(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_folders_made_in_a_block_are_removed(spark, tmp_path):
    outside = stage(spark.range(5), "kept")
    with staging(spark):
        inside = stage(spark.range(3), "dropped")
        unused = new_folder(spark, "unused")
        place = folder_of(inside)
        inside.write.parquet(str(tmp_path / "result"))
        assert os.path.exists(place)
    assert not os.path.exists(place) and not os.path.exists(unused)
    assert outside.count() == 5 and spark.read.parquet(str(tmp_path / "result")).count() == 3
    with pytest.raises(ZeroDivisionError), staging(spark):
        place = folder_of(stage(spark.range(3), "dropped"))
        1 / 0
    assert not os.path.exists(place)


def test_dropping_counts_what_was_there(spark):
    with staging(spark):
        stage(spark.range(1), "a")
        new_folder(spark, "never-written")
        stage(spark.range(1), "b")
        from reelbook import session

        assert drop_staged(spark, since=len(session._HANDED_OUT[spark.sparkContext.applicationId]) - 3) == 2
