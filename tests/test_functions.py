from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reelbook.functions import crop
from reelbook.functions import text as X


def value(spark, column, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize("seconds, text", [
    ("61.9", "01:01"), ("3600", "60:00"), ("6001.2", "100:01"), ("0", "00:00"), ("59.999", "00:59"), ("600000", "10000:00"), ("x", None),
])
def test_mmss(spark, seconds, text):
    assert value(spark, X.mmss("s"), s=seconds) == text


@pytest.mark.parametrize("text, slug", [
    ("  A_b vs C! (2) -- x_", "a_b-vs-c-2-x"), ("VID0042.json", "vid0042json"), ("Élan Çà", "elan-ca"), ("--", ""), ("日本", ""), ("a–b", "ab"),
])
def test_slugify(spark, text, slug):
    assert value(spark, X.slugify("s"), s=text) == slug


@pytest.mark.parametrize("text, bare", [("a.mp4", "a"), ("abcd", ""), ("abc", ""), ("", ""), ("x.webm", "x.")])
def test_drop_ext4(spark, text, bare):
    assert value(spark, X.drop_ext4("s"), s=text) == bare


@pytest.mark.parametrize("text, stem", [("a.b.mp4", "a"), ("plain", "plain"), (".mp4", "")])
def test_stem(spark, text, stem):
    assert value(spark, X.stem("s"), s=text) == stem


def test_offset_is_read_past(spark):
    got = value(spark, X.effective_date("a", "b"), a="2024-01-02T03:04:05+02:00", b="2020-01-01T00:00:00Z")
    assert got == datetime(2024, 1, 2, 3, 4, 5)


def test_default_publication(spark):
    got = value(spark, X.default_publication(F.lit("2024-03-01 00:30:00").cast("timestamp_ntz")))
    assert got == datetime(2024, 2, 29, 18)


@pytest.mark.parametrize("status, date, label", [
    ("public", "2030-01-01", "public"), ("unlisted", "2030-01-01", "unlisted"), ("private", "2024-01-01", "scheduled"),
    ("private", "2023-12-31", "private"), ("", "2030-01-01", "private"),
])
def test_status_label(spark, status, date, label):
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    assert value(spark, X.status_label("s", F.col("d").cast("timestamp_ntz"), as_of), s=status, d=date) == label


@pytest.mark.parametrize("status, date, due", [
    ("private", "2024-01-02", True), ("unlisted", "2024-01-02", True), ("public", "2024-01-02", False), ("private", "2024-01-01", False),
])
def test_publish_schedule(spark, status, date, due):
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    got = value(spark, X.publish_schedule("s", F.col("d").cast("timestamp_ntz"), as_of), s=status, d=date)
    assert (got and tuple(got)) == (("private", "2024-01-02T00:00:00+00:00") if due else None)


@pytest.mark.parametrize("text, pattern, hit", [("a%b", "%", True), ("ab", "%", False), ("a_b", "_B", True), ("ab", "", True)])
def test_ci_contains_is_literal(spark, text, pattern, hit):
    assert value(spark, X.ci_contains("t", "p"), t=text, p=pattern) is hit


def test_draw_time_code_is_a_stable_fraction(spark):
    df = spark.range(1000).select(X.draw_time_code("id", F.lit(1)).alias("x"))
    a, b = df.collect(), df.repartition(7).collect()
    assert sorted(a) == sorted(b) and all(0 <= r.x < 1 for r in a) and len(set(a)) > 990


@pytest.mark.parametrize("w, h, box", [(1920, 1080, (1920.0, 1080.0)), (2000, 900, (1600.0, 900.0)), (1600, 1600, (1600.0, 900.0))])
def test_aspect_crop(spark, w, h, box):
    assert tuple(value(spark, crop.aspect_crop("w", "h"), w=w, h=h)) == box


def test_crop_window(spark):
    assert tuple(value(spark, crop.crop_window("x", "y", "z"), x=0.5, y=1.0, z=2.0)) == (1260, 1080, 3180, 2160)


@pytest.mark.parametrize("w, h, size", [(100, 50, (850, 425)), (100, 200, (425, 850)), (100, 100, (850, 850))])
def test_logo_size(spark, w, h, size):
    assert tuple(value(spark, crop.logo_size("w", "h"), w=w, h=h)) == size


def test_title_pos(spark):
    assert tuple(value(spark, crop.title_pos("w"), w=401)) == (1540, 600)


def test_normalise_crop_is_idempotent_and_in_bounds(spark):
    grid = spark.range(0, 9000).select(
        ((F.col("id") % 30) / 10 - 1).alias("x"), (F.floor(F.col("id") / 30) % 30 / 10 - 1).alias("y"), (F.floor(F.col("id") / 900) - 2).cast("double").alias("z")
    )
    once = grid.select(crop.normalise_crop("x", "y", "z").alias("c")).select("c.*")
    twice = once.select("*", crop.normalise_crop("x_offset", "y_offset", "zoom").alias("d"))
    off = twice.where(
        (F.abs(F.col("d.x_offset") - F.col("x_offset")) > 1e-12) | (F.abs(F.col("d.y_offset") - F.col("y_offset")) > 1e-12)
        | (F.col("d.zoom") != F.col("zoom")) | ~F.col("x_offset").between(0, 1) | ~F.col("y_offset").between(0, 1) | ~F.col("zoom").between(1, 5)
    )
    assert off.count() == 0
