"""Exactness on random and skewed data, and plans that hold at scale."""

import random

import pytest
from pyspark.sql import functions as F

from reelbook.operators import linking, numbering, teams
from reelbook.operators.describe import number_chapters
from reelbook.operators.joins import lookup
from reelbook.operators.substring import first_text_with, patterns_in
from reelbook import session
from reelbook.plans import nested
from reelbook.session import new_folder
from reelbook.sources import catalogue, documents, entities, files
from reelbook.streaming import upsert
from tests.helpers import final_plan, plan, rows, table, ts
from tests.test_rules import LOGOS, entities as small_entities, items, recordings, videos

NESTED = ("NestedLoop", "CartesianProduct")


def words(seed, n, longest, letters="ab"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("salts", [1, 8])
def test_substrings_equal_brute_force(spark, seed, salts):
    texts = list(enumerate(words(seed, 120, 40)))
    patterns = sorted({p for p in words(seed + 100, 150, 20) if p})
    t = spark.createDataFrame([(s, i) for i, s in texts], "text string, rank long")
    p = spark.createDataFrame([(s,) for s in patterns], "pattern string")
    want = sorted((q, min(i for i, s in texts if q in s)) for q in patterns if any(q in s for _, s in texts))
    assert rows(first_text_with(t, p, salts=salts)) == want
    pairs = sorted({(s, q) for _, s in texts for q in patterns if q in s})
    assert sorted(rows(patterns_in(t.select("text").distinct(), p, salts=salts).select("text", "pattern").distinct())) == pairs


@pytest.mark.parametrize("seed", range(3))
def test_relink_equals_nested_loop(spark, seed):
    names, titles = words(seed, 60, 30, "aB c"), words(seed + 7, 80, 12, "Ab C")
    rec = recordings(spark, *[{"pk": i, "name": n, "video_name": n[::-1] + "x", "tournament": i % 3} for i, n in enumerate(names)])
    yt = videos(spark, *[{"pk": i, "title": t} for i, t in enumerate(titles)])
    for tournament in (None, 1):
        pool = rec if tournament is None else rec.where(F.col("tournament") == tournament)
        side = pool.select(F.col("pk").alias("rec"), F.lower("name").alias("a"), F.lower("video_name").alias("b"))
        low = F.lower("title")
        want = yt.join(side, F.contains("a", low) | F.contains("b", low), "left").groupBy("pk").agg(F.min("rec"))
        assert rows(linking.relink_videos(yt, rec, tournament=tournament)) == rows(want)


def test_teams_equal_brute_force(spark):
    rng = random.Random(5)
    logos = [{"pk": i + 1, "name": w or "x", "short_name": s} for i, (w, s) in enumerate(zip(words(1, 40, 6, "abc"), words(2, 40, 3, "abcd")))]
    names = words(3, 80, 25, "abcdE ")
    rng.shuffle(names)

    def expected(name):
        hits = [g for g in logos if g["short_name"].lower() in name.lower() or g["name"].lower() in name.lower()]
        hits.sort(key=lambda g: (len(g["short_name"]), g["pk"]))
        found = [1, 1] + [g["pk"] for g in hits[:2]]
        return name, found[-1], found[-2]

    files_ = spark.createDataFrame([(n,) for n in names], "name string")
    assert rows(teams.identify_teams(files_, table(spark, "team_logos", logos))) == sorted(map(expected, names), key=str)


def test_linking_plans_have_no_nested_loop(spark):
    yt, rec = videos(spark, {"pk": 1, "title": "a"}), recordings(spark, {"pk": 1, "name": "a", "video_name": "b"})
    logos = table(spark, "team_logos", LOGOS)
    texts = rec.select(F.col("name").alias("text"), F.col("pk").alias("rank"))
    for df in (
        teams.identify_teams(rec.select("name"), logos), linking.relink_videos(yt, rec), linking.link_exact(yt, rec, 1),
        linking.link_unlinked(yt, rec), linking.claim_unlinked(yt, rec), linking.unlinked_candidates(yt, rec),
        first_text_with(texts, yt.select(F.col("title").alias("pattern"))),
    ):
        assert not any(word in plan(df) for word in NESTED), plan(df)


@pytest.mark.parametrize("limit, joins", [(1 << 25, "BroadcastHashJoin"), (-1, "SortMergeJoin")])
def test_cut_texts_are_never_broadcast(spark, monkeypatch, limit, joins):
    """Small patterns are the broadcast side by measure; large ones are merged, whatever Spark estimates."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    texts = spark.createDataFrame([(w, i) for i, w in enumerate(words(9, 300, 40))], "text string, rank long")
    patterns = spark.createDataFrame([(w,) for w in sorted(set(words(8, 200, 15)) - {""})], "pattern string")
    got = first_text_with(texts, patterns)
    text = final_plan(got)
    assert text.count(joins) == 2 and ("SortMergeJoin" in text) == (limit < 0)
    if limit > 0:
        assert "BuildLeft" not in text
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1 << 25)
    assert rows(got) == rows(first_text_with(texts, patterns))


def skewed(spark, n=6000):
    """Rows of which a third belong to group 0 and the others to 200 groups."""
    return spark.range(n).select(F.col("id").alias("pk"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200 + 1).cast("long").alias("parent"))


def test_numbering_of_a_hot_group(spark):
    df = skewed(spark)
    got = numbering.number_within(df, ["parent"], "pk", 100.0)
    want = df.selectExpr("pk", "parent", "cast(row_number() over (partition by parent order by pk) as bigint) as position")
    assert rows(got) == rows(want.select(got.columns))
    sizes = df.withColumn("_slice", F.floor(F.col("pk") / 100.0)).groupBy("parent", "_slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 100


def test_numbering_keeps_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 5.0, "a"), (None, None, "b"), (1, None, "c"), (1, 700.0, "d"), (1, 3.0, "e")], "g long, v double, k string")
    got = numbering.number_within(df, ["g"], "v", 600.0)
    assert rows(got, "k", "position") == [("a", 2), ("b", 1), ("c", 1), ("d", 3), ("e", 2)]


def test_substrings_count_characters(spark):
    texts = spark.createDataFrame([("été 🏆 finale", 1), ("日本対決", 2)], "text string, rank long")
    patterns = spark.createDataFrame([("🏆 fin",), ("té",), ("本対決",), ("日",), ("🏆x",)], "pattern string")
    assert sorted(tuple(r) for r in first_text_with(texts, patterns).collect()) == sorted([("🏆 fin", 1), ("té", 1), ("本対決", 2), ("日", 2)])


def test_pages_of_a_hot_parent_are_bounded_and_whole(spark):
    tables = small_entities(
        spark, team_logos=[{"pk": 1, "name": "hot", "short_name": "h"}, {"pk": 2, "name": "none", "short_name": "n"}],
        teams=[{"pk": i, "name": f"t{i}", "logo": 1} for i in range(1, 124)],
    )
    got = nested.embed_related(tables, "team_logos", "http://h", many=nested.EMBED_MANY["team_logos"], page_size=50)
    assert rows(got.select("pk", "page", F.size("teams"))) == [(1, 0, 50), (1, 1, 50), (1, 2, 23), (2, 0, 0)]
    assert [r[0] for r in got.select("page", F.explode("teams.pk").alias("c")).orderBy("page", "c").select("c").collect()] == list(range(1, 124))


def test_chapter_numbers_do_not_depend_on_partitions(spark):
    data = [(v, str(s * 137.5), str(s)) for v, n in ((1, 80), (2, 3)) for s in range(n)]
    df = spark.createDataFrame(data, "video long, start_time string, end_time string")
    want = [(v, str(s * 137.5), str(s), s + 1) for v, n in ((1, 80), (2, 3)) for s in range(n)]
    for parts in (1, 5):
        assert rows(number_chapters(df.repartition(parts))) == sorted(want, key=str)


def test_surrogate_keys_are_consecutive_and_repeatable(spark):
    df = spark.range(500).select(F.concat(F.lit("name"), F.col("id")).alias("name"))
    first = numbering.surrogate_keys(df, ["name"], F.lit(10))
    again = numbering.surrogate_keys(df.repartition(7), ["name"], F.lit(10), digits=1)
    assert rows(first) == rows(again)
    assert sorted(r.pk for r in first.collect()) == list(range(11, 511))


def test_hot_foreign_key_is_split(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        folder = new_folder(spark, "hot")
        skewed(spark, 60000).repartition(8).write.parquet(f"{folder}/facts")
        facts = spark.read.parquet(f"{folder}/facts")
        dim = spark.range(201).select(F.col("id").alias("pk"), F.concat(F.lit("n"), F.col("id")).alias("name"))
        df = lookup(facts, dim, "parent", {"shown": "name"})
        text = final_plan(df)
        assert "SortMergeJoin(skew=true)" in text
        assert df.where(F.col("shown") == F.concat(F.lit("n"), F.col("parent"))).count() == 60000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_copies_of_one_title_and_one_item(spark):
    rec = recordings(spark, {"pk": 1, "name": "cup final.mp4", "video_name": "x"})
    yt = spark.range(3000).select(
        F.col("id").alias("pk"), F.when(F.col("id") % 3 == 0, "final").otherwise(F.concat(F.lit("q"), F.col("id"))).alias("title"),
        F.concat(F.lit("v"), F.col("id")).alias("video_id"), F.lit(None).cast("long").alias("linked_video"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("publication_date"), F.lit("private").alias("privacy_status"),
    )
    assert linking.relink_videos(yt, rec).where("linked_video = 1").count() == 1000
    assert linking.claim_unlinked(yt, recordings(spark, {"pk": 1, "name": "final.mp4", "video_name": "x"})).where("linked_video = 1").count() == 1


def test_listing_leaves_contents_alone(spark, tmp_path):
    for name in ("a.mp4", "b.txt", "c.MOV", "é d%20.mkv"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.mp4").write_text("x")
    df = files.list_video_files(files.listing(spark, str(tmp_path)))
    assert [r[0] for r in rows(df, "name")] == ["a.mp4", "c.MOV", "é d%20.mkv"]
    scan = next(line for line in plan(df).splitlines() if "FileScan" in line)
    assert "content" not in scan.split("ReadSchema")[1]


def test_tournament_filter_reads_one_folder(spark):
    folder = new_folder(spark, "snapshot")
    rec = recordings(spark, *[{"pk": i, "name": f"n{i}", "video_name": "", "tournament": i % 4 or None} for i in range(40)])
    entities.write_entity(rec, folder, "video_metadata")
    back = entities.scan_entity(spark, folder, "video_metadata")
    assert back.schema == rec.schema and rows(back) == rows(rec)
    picked = back.where(F.col("tournament") == 2)
    assert "PartitionFilters: [isnotnull(tournament" in plan(picked) and picked.count() == 10


def test_pushdown_and_pruning(spark):
    folder = new_folder(spark, "snapshot")
    entities.write_entity(videos(spark, {"pk": 1, "title": "a", "linked_video": 1}), folder, "yt_videos")
    from reelbook.operators.counts import publish_status_per_video

    text = plan(publish_status_per_video(entities.scan_entity(spark, folder, "yt_videos"), F.lit("2024-01-01").cast("timestamp_ntz")))
    assert "IsNotNull(linked_video)" in text and "title" not in text.split("ReadSchema")[1].splitlines()[0]
    assert "SortAggregate" not in text


def test_edit_documents_per_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{\n "team1": "A",\n "files": ["x", "y"],\n "verified": true,\n "cuts": [{"a": 1}]\n}')
    got = documents.read_edit_documents(spark, str(tmp_path), per_file=True)
    assert rows(got, "json_file", "team1", "files", "verified", "Warnings") == [("g.json", "A", ["x", "y"], True, None)]
    assert rows(got.select(F.get_json_object(F.col("cuts")[0], "$.a"))) == [("1",)]


BATCHES = [
    [(0, 0, "a", "A", "2024-02-01", "public"), (0, 1, "n", "N", "2024-02-01", "private")],
    [(0, 0, "a", "AA", "2024-02-02", "public"), (0, 1, "n", "N", "2024-02-02", "public")],
    [(0, 0, "a", "A", "2024-02-03", "unlisted"), (0, 1, "m", "M", "2024-02-03", "public")],
]


def _page(batch):
    item = F.struct(
        F.lit("youtube#video").alias("kind"), F.col("video_id").alias("id"),
        F.struct("title", "description", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"),
        F.struct(F.col("status").alias("privacyStatus")).alias("status"),
    )
    return batch.groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("item_pos", item.alias("item")))).alias("e")).select(
        "page_no", F.transform("e", lambda e: e["item"]).alias("items")
    )


def test_stream_equals_upsert_batch_by_batch(spark):
    from reelbook.operators.changes import upsert_catalogue

    landed, log, state = new_folder(spark, "pages"), new_folder(spark, "log"), new_folder(spark, "state")
    base = videos(spark, {"pk": 1, "video_id": "a", "title": "A"})
    want = base
    for batch in BATCHES:
        df = items(spark, *batch)
        want = upsert_catalogue(want, df)
        _page(df).coalesce(1).write.mode("append").json(landed)
        query = upsert.stream_catalogue_upsert(upsert.read_page_stream(spark, landed, max_files=1), log, state)
        query.awaitTermination()
    got = upsert.current_videos(base, upsert.read_log(spark, log))
    columns = [c for c in base.columns if c != "pk"]
    assert rows(got, *columns) == rows(want, *columns)
    assert rows(got, "video_id", "title", "privacy_status") == [("a", "A", "unlisted"), ("m", "M", "public"), ("n", "N", "private")]


def test_replayed_batch_changes_nothing(spark):
    landed, log = new_folder(spark, "pages"), new_folder(spark, "log")
    _page(items(spark, *BATCHES[0])).write.json(landed)
    seen = []
    for _ in range(2):  # the second run has lost its progress and replays the batch
        upsert.stream_catalogue_upsert(upsert.read_page_stream(spark, landed), log, new_folder(spark, "state")).awaitTermination()
        seen.append(rows(upsert.read_log(spark, log)))
    assert seen[0] == seen[1] and len(seen[0]) == 2


def test_upsert_does_not_depend_on_partitions(spark):
    from reelbook.operators.changes import upsert_catalogue

    rng = random.Random(3)
    new = items(spark, *[(p, i, f"v{rng.randint(0, 30)}", rng.choice("ABC"), f"2024-02-{p + 1:02d}", rng.choice(["x", "y"])) for p in range(9) for i in range(20)])
    yt = videos(spark, *[{"pk": i, "video_id": f"v{i}", "title": "A"} for i in range(15)])
    one, many = upsert_catalogue(yt, new.repartition(1)), upsert_catalogue(yt.repartition(3), new.repartition(11))
    assert rows(one) == rows(many)
    # One item at a time.
    state = {f"v{i}": ("A", "2024-01-01", "private") for i in range(15)}
    for r in sorted(new.collect(), key=lambda r: (r.page_no, r.item_pos)):
        if r.video_id not in state or state[r.video_id][0] != r.title:
            state[r.video_id] = (r.title, f"{r.date:%Y-%m-%d}", r.status)
    got = {r.video_id: (r.title, f"{r.publication_date:%Y-%m-%d}", r.privacy_status) for r in one.collect()}
    assert got == state


def test_publish_bodies(spark):
    rec = recordings(spark, {"pk": 1, "name": "a", "video_name": "T", "description": "D", "publication_date": ts("2030-01-01T10:00:00")})
    yt = videos(spark, {"pk": 1, "linked_video": 1, "privacy_status": "unlisted"}, {"pk": 2, "linked_video": 1, "privacy_status": "public"}, {"pk": 3})
    got = {r.video_id: r.body for r in catalogue.publish_payloads(yt, rec, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    snippet = '"snippet":{"title":"T","description":"D","tags":["jugger","tournament","sport"],"categoryId":"17","kids":false}'
    assert got == {
        "v1": '{"id":"v1",' + snippet + ',"status":{"privacyStatus":"private","publishAt":"2030-01-01T10:00:00+00:00"}}',
        "v2": '{"id":"v2",' + snippet + ',"status":{}}',
    }


def test_collection_items(spark):
    payloads = [(1, '[{"a":1},{"b":2}]'), (2, '{"_embedded":{"x":1,"y":[{"c":3}],"z":[4]}}'), (3, '{"_embedded":{"y":{"d":5}}}'), (4, '{"n":0}'), (5, "[]"), (6, '{"_embedded":{"y":[],"z":[1]}}')]
    got = nested.collection_items(spark.createDataFrame(payloads, "pk long, payload string"), "pk")
    assert rows(got) == [(1, 0, '{"a":1}'), (1, 1, '{"b":2}'), (2, 0, '{"c":3}'), (3, 0, '{"d":5}')]


class _Session:
    """Session stand-in without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})


def test_only_a_local_session_makes_its_own_folder():
    assert session.shared_folder(_Session("local[2]")) == session.shared_folder(_Session("local[4]"))
    with pytest.raises(ValueError):
        session.shared_folder(_Session("spark://host:7077"))
