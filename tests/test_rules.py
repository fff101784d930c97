"""Hand-written edge cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from reelbook.operators import changes, describe, linking, listings, quality, teams
from reelbook.operators.counts import duplicate_keys, publish_status_per_video
from reelbook.operators.joins import resolve_entity_url
from reelbook.plans.thumbnails import plan_thumbnails
from reelbook.sources import catalogue, files
from tests.helpers import rows, table, ts

LOGOS = [
    {"pk": 1, "name": "Alpha Team", "short_name": "AT"}, {"pk": 2, "name": "Beta", "short_name": "B"},
    {"pk": 3, "name": "Gamma Gang", "short_name": "GG"},
]


def named(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_team_rule(spark):
    got = teams.identify_teams(named(spark, "beta vs gamma gang.mp4", "GG x.mkv", "none.mov"), table(spark, "team_logos", LOGOS))
    assert rows(got) == [("GG x.mkv", 3, 1), ("beta vs gamma gang.mp4", 3, 2), ("none.mov", 1, 1)]


def test_one_letter_abbreviation_and_copies(spark):
    logos = table(spark, "team_logos", LOGOS + [{"pk": 4, "name": "Beta", "short_name": "B"}, {"pk": 5, "name": "Beta", "short_name": "B"}])
    got = teams.identify_teams(named(spark, "cab.mp4", "cab.mp4", "CAB.mp4"), logos)
    assert rows(got) == [("CAB.mp4", 4, 2), ("cab.mp4", 4, 2), ("cab.mp4", 4, 2)]


def test_empty_abbreviation_matches_every_name(spark):
    logos = table(spark, "team_logos", LOGOS + [{"pk": 9, "name": "Nobody", "short_name": ""}])
    got = teams.identify_teams(named(spark, "zzz", "AT"), logos)
    assert rows(got) == [("AT", 1, 9), ("zzz", 9, 1)]


def test_camera_parts(spark):
    listed = named(spark, "GX010042.MP4", "GX020042.MP4", "GX01x.MP4", "gx010007.MP4", "GX010042.MP4x").withColumn("dir", F.lit("/d/"))
    grouped = describe.group_recording_parts(files.camera_parts(listed))
    assert rows(grouped) == [("/d/", 42, [1, 2], ["GX010042.MP4", "GX020042.MP4"])]


def test_video_suffixes_are_case_sensitive(spark):
    listed = named(spark, "a.mp4", "b.MP4", "c.Mp4", "d.mov", "e.MOV", "f.avi", "g.AVI", "h.mkv", ".mp4", "i.mp4.txt")
    assert [r[0] for r in rows(files.list_video_files(listed))] == ["a.mp4", "b.MP4", "d.mov", "e.MOV", "f.avi", "h.mkv"]


def recordings(spark, *items):
    base = {"tournament": 1, "publication_date": ts("2024-01-01"), "description": ""}
    return table(spark, "video_metadata", [base | i for i in items])


def videos(spark, *items):
    base = {"publication_date": ts("2024-01-01"), "privacy_status": "private"}
    return table(spark, "yt_videos", [base | {"video_id": f"v{i['pk']}"} | i for i in items])


def test_empty_title_links_to_lowest_recording(spark):
    rec = recordings(spark, {"pk": 7, "name": "b", "video_name": ""}, {"pk": 5, "name": "a", "video_name": "x"})
    got = linking.relink_videos(videos(spark, {"pk": 1, "title": ""}, {"pk": 2, "title": "B"}, {"pk": 3, "title": "q"}, {"pk": 4, "title": None}), rec)
    assert rows(got) == [(1, 5), (2, 7), (3, None), (4, None)]


def test_relink_scope_and_latest(spark):
    rec = recordings(
        spark, {"pk": 1, "name": "cup final", "video_name": "", "publication_date": ts("2024-01-01")},
        {"pk": 2, "name": "the cup", "video_name": "", "publication_date": ts("2024-02-01")},
        {"pk": 3, "name": "other", "video_name": "", "tournament": 2},
    )
    yt = videos(spark, {"pk": 1, "title": "CUP"}, {"pk": 2, "title": "none", "linked_video": 9}, {"pk": 3, "title": "other"})
    assert rows(linking.relink_apply(yt, rec), "pk", "linked_video") == [(1, 1), (2, None), (3, 3)]
    assert rows(linking.relink_apply(yt, rec, latest=True), "pk", "linked_video") == [(1, 2), (2, None), (3, 3)]
    assert rows(linking.relink_apply(yt, rec, scope="matched", tournament=2), "pk", "linked_video") == [(1, None), (2, 9), (3, 3)]
    assert rows(linking.relink_apply(yt, rec, tournament=1), "pk", "linked_video") == [(1, 1), (2, None), (3, None)]
    with pytest.raises(ValueError):
        linking.relink_apply(yt, rec, scope="some")


def test_claims_go_to_lowest_recording(spark):
    rec = recordings(spark, {"pk": 2, "name": "a.mp4", "video_name": "t"}, {"pk": 1, "name": "a.mov", "video_name": "u"}, {"pk": 3, "name": "z", "video_name": "u"})
    yt = videos(spark, {"pk": 10, "title": "a"}, {"pk": 11, "title": "u"}, {"pk": 12, "title": "t", "linked_video": 3})
    assert rows(linking.claim_unlinked(yt, rec), "pk", "linked_video") == [(10, 1), (11, 3), (12, 3)]


def test_exact_link_takes_file_names_of_one_tournament_only(spark):
    rec = recordings(spark, {"pk": 1, "name": "a", "video_name": "A", "tournament": 2}, {"pk": 2, "name": "a", "video_name": "B", "tournament": 1})
    yt = videos(spark, {"pk": 1, "title": "a"}, {"pk": 2, "title": "A"}, {"pk": 3, "title": "B", "linked_video": 1}, {"pk": 4, "title": "x"})
    assert rows(linking.link_exact(yt, rec, 1), "pk", "linked_video") == [(1, 2), (2, 1), (3, 1), (4, None)]


def items(spark, *values):
    return spark.createDataFrame(
        [(p, i, v, t, "", ts(d), s) for p, i, v, t, d, s in values],
        "page_no long, item_pos int, video_id string, title string, description string, date timestamp_ntz, status string",
    )


def test_upsert(spark):
    yt = videos(spark, {"pk": 4, "video_id": "a", "title": "A"}, {"pk": 9, "video_id": "b", "title": "B"})
    new = items(spark, (0, 0, "a", "A", "2024-02-01", "public"), (0, 1, "b", "BB", "2024-02-02", "public"), (0, 2, "c", "C", "2024-02-03", "public"))
    got = changes.upsert_catalogue(yt, new)
    assert rows(got, "pk", "video_id", "title", "publication_date", "privacy_status") == [
        (10, "c", "C", ts("2024-02-03"), "public"), (4, "a", "A", ts("2024-01-01"), "private"), (9, "b", "BB", ts("2024-02-02"), "public"),
    ]
    assert rows(changes.upsert_catalogue(got, new)) == rows(got)
    every = changes.upsert_catalogue(yt, new, update_on="any")
    assert rows(every.where("video_id = 'a'"), "publication_date", "privacy_status") == [(ts("2024-02-01"), "public")]


def test_upsert_applies_copies_one_after_the_other(spark):
    yt = videos(spark, {"pk": 1, "video_id": "a", "title": "A"}, {"pk": 2, "video_id": "b", "title": "B"})
    new = items(
        spark,
        # A, X, A: the title is back, but date and status are those of the last change.
        (0, 0, "a", "A", "2024-02-01", "s1"), (0, 1, "a", "X", "2024-02-02", "s2"), (1, 0, "a", "A", "2024-02-03", "s3"), (1, 1, "a", "A", "2024-02-04", "s4"),
        # A copy with the current title changes nothing.
        (0, 2, "b", "C", "2024-02-01", "s1"), (1, 2, "b", "C", "2024-02-02", "s2"),
        (0, 3, "n", "N", "2024-02-01", "s1"), (1, 3, "n", "N", "2024-02-02", "s2"), (2, 3, "n", "M", "2024-02-03", "s3"),
    )
    got = changes.upsert_catalogue(yt, new.repartition(3))
    assert rows(got, "video_id", "title", "publication_date", "privacy_status") == [
        ("a", "A", ts("2024-02-03"), "s3"), ("b", "C", ts("2024-02-01"), "s1"), ("n", "M", ts("2024-02-03"), "s3"),
    ]


def test_items_of_both_kinds(spark):
    page = """{"page_no": 3, "items": [
        {"kind": "youtube#video", "id": "v1", "snippet": {"title": "T", "description": "", "publishedAt": "2024-01-01T00:00:00Z"},
         "status": {"privacyStatus": "private", "publishAt": "2024-05-01T10:00:00+02:00"}},
        {"kind": "youtube#playlistItem", "id": "i2", "snippet": {"title": "U", "publishedAt": "2024-01-02T00:00:00Z", "resourceId": {"videoId": "v2"}},
         "status": {"privacyStatus": "public"}}]}"""
    from reelbook.schemas import CATALOGUE_PAGE

    pages = spark.createDataFrame([(page,)], "p string").select(F.from_json("p", CATALOGUE_PAGE).alias("p")).select("p.*")
    got = catalogue.catalogue_items(pages)
    assert rows(got, "page_no", "item_pos", "video_id", "date", "status") == [
        (3, 0, "v1", ts("2024-05-01T10:00:00"), "private"), (3, 1, "v2", ts("2024-01-02"), "public"),
    ]


def test_last_online_video_gives_the_status(spark):
    yt = videos(
        spark, {"pk": 1, "linked_video": 5, "privacy_status": "public"}, {"pk": 2, "linked_video": 5, "privacy_status": "unlisted"},
        {"pk": 3, "linked_video": 6, "privacy_status": "private", "publication_date": ts("2030-01-01")}, {"pk": 4},
    )
    assert rows(publish_status_per_video(yt, F.lit("2024-01-01").cast("timestamp_ntz"))) == [(5, "unlisted"), (6, "scheduled")]


def test_null_tournament_is_no_duplicate(spark):
    rec = recordings(spark, {"pk": 1, "name": "a"}, {"pk": 2, "name": "a"}, {"pk": 3, "name": "b", "tournament": None}, {"pk": 4, "name": "b", "tournament": None})
    assert rows(duplicate_keys(rec, ["name", "tournament"])) == [("a", 1, 2)]


def test_description_text(spark):
    rec = recordings(spark, {"pk": 1, "name": "a.mp4", "team1": 1, "team2": 2}, {"pk": 2, "name": "b.mp4", "team1": 1, "team2": 2})
    cups = table(spark, "tournaments", [{"pk": 1, "name": "Cup", "date": date(2024, 5, 1), "JTR": "http://j", "tugeny_link": ""}])
    chapters = spark.createDataFrame([(1, "100.5", "1"), (1, "9.0", "2"), (1, "6060.0", "3")], "video long, start_time string, end_time string")
    table_after = changes.reset_metadata(rec, cups, table(spark, "team_logos", LOGOS), describe.chapter_probes(chapters))
    got = {r.pk: r for r in table_after.collect()}
    assert got[1].description == "Alpha Team vs Alpha Team\nRefered by : \n2024-05-01\n\n\nhttp://j\n\n00:09 Point 1\n01:40 Point 2\n101:00 Point 3"
    assert got[2].description == "Beta vs Alpha Team\nRefered by : \n2024-05-01\n\n\nhttp://j\n"
    assert got[2].video_name == "Beta vs Alpha Team | CUP [JUGGER]"


def test_reset_leaves_recordings_without_tournament(spark):
    rec = recordings(spark, {"pk": 1, "name": "beta", "tournament": None, "team1": 3, "team2": None, "video_name": "old", "description": "d"})
    cups = table(spark, "tournaments", [{"pk": 1, "name": "Cup", "date": date(2024, 5, 1)}])
    probes = spark.createDataFrame([], "video long, chapters array<struct<start_time:string,end_time:string>>")
    got = changes.reset_metadata(rec, cups, table(spark, "team_logos", LOGOS), probes)
    assert rows(got, "team1", "team2", "video_name", "description") == [(3, None, "old", "d")]


def test_crop_edit(spark):
    rec = recordings(
        spark, *[{"pk": p, "name": "n.mp4", "team1": 1, "team2": 2, "video_name": "old", "description": "d", "miniature_x_offset": 0.0,
                  "miniature_y_offset": 0.0, "miniature_zoom": 1.0, "time_code": 0.0} for p in (1, 2, 3, 5)],
        {"pk": 4, "name": "n", "tournament": None, "team1": 1, "team2": 2, "video_name": "old", "description": "d", "miniature_x_offset": 0.0,
         "miniature_y_offset": 0.0, "miniature_zoom": 1.0, "time_code": 0.0},
    )
    edits = spark.createDataFrame(
        [(1, "0.5", "bad", "2", "0.1", None, 3), (2, None, "0.5", "2", "0.1", 1, 2), (3, "1e-1", "0.5", "nope", "0.1", 1, 3), (4, "0.5", "0.5", "2", "0.1", 3, 3)],
        "pk long, miniature_x_offset string, miniature_y_offset string, miniature_zoom string, time_code string, team1 long, team2 long",
    )
    cups = table(spark, "tournaments", [{"pk": 1, "name": "Cup", "date": date(2024, 5, 1)}])
    probes = spark.createDataFrame([], "video long, chapters array<struct<start_time:string,end_time:string>>")
    got = changes.apply_crop_edit(rec, edits, cups, table(spark, "team_logos", LOGOS), probes)
    assert rows(got, "pk", "miniature_x_offset", "miniature_y_offset", "miniature_zoom", "time_code", "team1", "team2", "video_name") == [
        (1, 0.5, 0.0, 1.0, 0.0, 1, 2, "old"),
        (2, 0.0, 0.5, 2.0, 0.1, 1, 2, "old"),
        (3, 0.1, 0.5, 1.0, 0.0, 1, 3, "Alpha Team vs Gamma Gang | CUP [JUGGER]"),
        (4, 0.0, 0.0, 1.0, 0.0, 1, 2, "old"),
        (5, 0.0, 0.0, 1.0, 0.0, 1, 2, "old"),
    ]


def test_resolve_entity_url(spark):
    urls = spark.createDataFrame(
        [("http://h/api/team_logos/2/",), ("/api/team_logos/3",), ("/api/teams/3/",), ("http://h/x?u=/team_logos/1/",), (None,), ("/api/team_logos/77/",), ("::",)], "u string"
    )
    got = resolve_entity_url(urls, "u", table(spark, "team_logos", LOGOS), "team_logos", alias="logo")
    assert {r.u: r.logo for r in got.collect()} == {
        "http://h/api/team_logos/2/": 2, "/api/team_logos/3": 3, "/api/teams/3/": None, "http://h/x?u=/team_logos/1/": None, None: None,
        "/api/team_logos/77/": None, "::": None,
    }


def test_patch_and_put(spark):
    yt = videos(spark, {"pk": 1, "title": "a", "linked_video": 3}, {"pk": 2, "title": "b", "linked_video": 4})
    patch = spark.createDataFrame([(1, None, None, True)], "pk long, title string, linked_video long, linked_video_set boolean")
    assert rows(changes.apply_patch(yt, patch, ["title", "linked_video"]), "pk", "title", "linked_video") == [(1, "a", None), (2, "b", 4)]
    assert rows(changes.apply_patch(yt, patch, ["title"], method="PUT"), "pk", "title", "linked_video") == [(1, None, 3), (2, "b", 4)]


def test_several_patches_of_a_row(spark):
    yt = videos(spark, {"pk": 1, "title": "a", "linked_video": 3, "privacy_status": "p"}, {"pk": 2, "title": "b"})
    patch = spark.createDataFrame(
        [(1, 1, "x", 7, None), (1, 2, None, None, True), (1, 3, None, None, None), (2, 1, "y", 5, None), (2, 2, "z", None, None)],
        "pk long, at int, title string, linked_video long, linked_video_set boolean",
    )
    got = changes.apply_patch(yt, patch, ["title", "linked_video"], order="at")
    assert rows(got, "pk", "title", "linked_video", "privacy_status") == [(1, "x", None, "p"), (2, "z", 5, "private")]
    put = changes.apply_patch(yt, patch, ["title", "linked_video"], order="at", method="PUT")
    assert rows(put, "pk", "title", "linked_video") == [(1, None, None), (2, "z", None)]


def entities(spark, **given):
    from reelbook.schemas import ENTITIES

    return {name: table(spark, name, given.get(name, [])) for name in ENTITIES}


def test_delete_cascade(spark):
    tables = entities(
        spark,
        tournaments=[{"pk": 1}, {"pk": 2}],
        games=[{"pk": 1, "tournament": 1, "team1": 1}, {"pk": 2, "tournament": 2, "team1": 1, "team2": 2}],
        cuts=[{"pk": 1, "game": 1}, {"pk": 2, "game": 2}],
        teams=[{"pk": 1, "logo": 1}, {"pk": 2, "logo": 2}],
        team_logos=[{"pk": 1}, {"pk": 2}],
        tmp_images=[{"pk": 1, "image": "one"}, {"pk": 2, "image": "two"}, {"pk": 3, "image": "three"}],
        video_metadata=[{"pk": 1, "tournament": 1, "team1": 1, "base_image": 1, "miniature_image": 2}, {"pk": 2, "tournament": 1, "base_image": 2, "miniature_image": 3, "team2": 1}],
        yt_videos=[{"pk": 1, "linked_video": 1}, {"pk": 2, "linked_video": 2}],
    )
    one = spark.createDataFrame([(1,)], "pk long")
    after, paths = changes.delete_cascade(tables, {"tournaments": one, "team_logos": one, "teams": one, "video_metadata": one})
    assert rows(after["games"], "pk", "team1", "team2") == [(2, None, 2)]
    assert rows(after["cuts"], "pk", "game") == [(1, None), (2, 2)]
    assert rows(after["teams"], "pk", "logo") == [(2, 2)]
    assert rows(after["video_metadata"], "pk", "tournament", "base_image", "miniature_image", "team2") == [(2, None, None, 3, None)]
    assert rows(after["yt_videos"], "pk", "linked_video") == [(1, None), (2, 2)]
    assert rows(paths) == [("two",)]
    assert rows(quality.orphan_report(after)) == []


def test_purge_bounds_are_inclusive(spark):
    tables = entities(
        spark,
        tmp_images=[{"pk": i, "date": date.fromisoformat(d), "image": f"i{i}"} for i, d in enumerate(["2010-12-31", "2011-01-01", "2024-01-01", "2024-01-02"])],
        video_metadata=[{"pk": 1, "base_image": 1, "miniature_image": 3}],
    )
    after, paths = changes.purge_images(tables, F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    assert rows(after["tmp_images"], "pk") == [(0,), (3,)] and rows(paths) == [("i1",), ("i2",)]
    assert rows(after["video_metadata"], "base_image", "miniature_image") == [(None, 3)]


def test_do_nothing_leaves_orphans(spark):
    tables = entities(spark, teams=[{"pk": 1, "logo": 1}], team_logos=[{"pk": 1}])
    after, _ = changes.delete_cascade(tables, {"team_logos": spark.createDataFrame([(1,)], "pk long")})
    assert rows(quality.orphan_report(after)) == [("teams", "logo", 1, 1)]


def test_only_stale_thumbnails_are_planned(spark):
    tables = entities(
        spark,
        tournaments=[{"pk": 1, "name": "Cup", "slug": "cup", "source_dir": "/d", "color": "#1"}],
        team_logos=LOGOS,
        tmp_images=[{"pk": 1, "name": "cup_final_0.5_base.jpeg"}, {"pk": 2, "name": "cup_final_0.5_thumbnail.jpeg"}],
        video_metadata=[
            {"pk": p, "name": "Final.mp4", "tournament": 1, "time_code": 0.5, "miniature_x_offset": 0.0, "miniature_y_offset": 0.0, "miniature_zoom": z,
             "team1": 1, "team2": 2, "base_image": b, "miniature_image": m}
            for p, z, b, m in [(1, 1.0, 1, 2), (2, 1.0, 1, None), (3, 1.0, None, 2), (4, 1.0, 2, 2), (5, 0.5, None, None)]
        ],
    )
    media = spark.createDataFrame([(p, 101.0, 1920, 1080) for p in range(1, 6)], "pk long, duration double, width int, height int")
    sizes = spark.createDataFrame([(1, 100, 100), (2, 100, 200)], "pk long, width int, height int")
    titles = spark.createDataFrame([(1, 400)], "pk long, width int")
    got = plan_thumbnails(tables, media, sizes, titles)
    assert rows(got, "pk", "decode_frame", "frame_second", "source") == [
        (2, False, 50, "/d/rendered/Final.mp4"), (3, True, 50, "/d/rendered/Final.mp4"), (4, True, 50, "/d/rendered/Final.mp4"),
    ]


def test_validation_reasons(spark):
    rec = recordings(
        spark, {"pk": 1, "name": "n" * 101, "video_name": "v", "description": "d", "team1": 1, "team2": 1},
        {"pk": 2, "name": "n", "video_name": "v", "description": "d", "team1": 1, "team2": 1}, {"pk": 3, "name": "n", "video_name": "v" * 121, "description": "d" * 5001, "team1": 1},
    )
    assert rows(quality.validate_entity(rec, "video_metadata"), "pk", "reasons") == [
        (1, ["name too long"]), (3, ["team2 required", "video_name too long", "description too long"]),
    ]
    cuts = table(spark, "cuts", [{"pk": 1, "name": "c", "type_cut": "X"}, {"pk": 2, "name": "c", "type_cut": "x"}, {"pk": 3, "name": "", "type_cut": None}])
    assert rows(quality.validate_entity(cuts, "cuts"), "pk", "reasons") == [(2, ["type_cut unknown"]), (3, ["name required", "type_cut required"])]


def test_admin_list_shows_names(spark):
    tables = entities(spark, teams=[{"pk": 1, "name": "t", "logo": 2}, {"pk": 2, "name": "u"}], team_logos=LOGOS)
    assert rows(listings.admin_list(tables, "teams")) == [("t", "Beta"), ("u", None)]
