"""Languages come from the rows themselves."""

from reelbook.llm import language
from reelbook.llm.common import prepare

TEXTS = {"en": "the cat and the dog went with this house that they have ", "de": "der hund und die katze sind nicht mit dem haus das sie haben ",
         "it": "il cane e la gatta non sono nella casa che loro hanno ", "nl": "de hond en de kat zijn niet in het huis dat zij hebben "}
SCHEMA = "doc_id long, text string, lang string, source string"


def found(spark, rows, **options):
    table = prepare(spark).createDataFrame(rows, SCHEMA)
    return {r["doc_id"]: r for r in language.identify_languages(table, declared="lang", host="source", markup=True, **options).collect()}


def test_any_declared_language_has_a_model(spark):
    rows = [(i, TEXTS[x] * 3, {"en": "en-US", "it": " IT"}.get(x, x), f"{x}{i % 3}") for i, x in enumerate(list(TEXTS) * 10)]
    # Undeclared, declared by markup behind a column that names no language, and declared wrongly.
    rows += [(100, TEXTS["it"] * 3, None, "it0"), (101, f"<html lang='it-CH'>{TEXTS['it'] * 3}", "unknown", "it1"), (102, TEXTS["it"] * 3, "en", "it2")]
    got = found(spark, rows)
    assert all(got[i]["language"] == x and got[i]["declared"] == x and got[i]["accepted"] for i, x in enumerate(list(TEXTS) * 10))
    assert [got[i]["language"] for i in (100, 101, 102)] == ["it"] * 3
    assert [got[i]["declared"] for i in (100, 101, 102)] == [None, "it", "en"]
    # The languages beyond the bound share one model.
    got = found(spark, rows + [(200 + i, TEXTS["en"] * 3, "en", "en0") for i in range(9)], most_languages=1)
    assert {got[i]["language"] for i, x in enumerate(list(TEXTS) * 10) if x != "en"} == {"other"} and got[0]["language"] == "en"


def test_without_rows_of_a_language_nothing_is_claimed(spark):
    got = found(spark, [(i, TEXTS["de"] * 3, None, "h") for i in range(5)] + [(9, None, None, None)])
    assert all((r["language"], r["text_language"], r["accepted"]) == ("und", "und", False) for r in got.values()) and len(got) == 6
    # A language declared by rows without letters only has no model.
    got = found(spark, [(i, TEXTS["de"] * 3, "de", "h") for i in range(5)] + [(9, "123", "aa", "h"), (10, "x" * 3, "aa", None)][:1])
    assert got[9]["declared"] is None and got[9]["language"] == "und" and got[0]["language"] == "de"
