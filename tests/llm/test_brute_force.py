"""Languages, importance sample and the chained pipeline against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reelbook.llm import importance, language
from reelbook.llm.common import prepare, read_table
from reelbook.llm.tokens import END_ID, word_tokenizer_path
from reelbook.session import stage
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SYLLABLES = {"en": "the th ing er an wh ou", "de": "ein sch ich der un ge ß", "it": "che la zio ne di il ò"}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n))


def parts(host):
    host = (host or "").lower()
    return host, (re.search(r"\.([^.]+)$", host) or [None, ""])[1]


def noise_of(spark, keys, seed=7):
    """Half and Gumbel noise of keys, which the sample takes from a hash."""
    table = spark.createDataFrame([(k,) for k in set(keys)], "k long")
    unit = (F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    got = table.select("k", F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(2)) == 0, -F.log(-F.log(unit))).collect()
    return {k: h for k, h, _ in got}.__getitem__, {k: n for k, _, n in got}.__getitem__


def same_languages(got, want, key):
    assert len(got) == len(want)
    for r in got:
        best, sure, guess, said, accepted = want[r[key]]
        assert (r["language"], r["text_language"], r["declared"], r["accepted"]) == (best, guess, said, accepted), r
        assert r["posterior"] == pytest.approx(sure, abs=1e-6)


def test_languages(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, l, rng.choice([1, 3, 40])), rng.choice([l, l, None, "en-GB", "und"]), f"h{rng.randrange(5)}.{l[:1]}x", 1) for i, l in
            enumerate(rng.choices(list(SYLLABLES), k=90))]
    rows += [(200, None, "en", None, 1), (201, "", None, "h0.ex", 1), (202, "12 34", "de", "", 1), (203, words(rng, "it", 30_000), None, None, 1)]
    rows += [(300 + i, rows[5][1], "it", "hot.org", 1) for i in range(40)]  # ties and one hot host
    table = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, declared int")
    got = language.identify_languages(table, declared="lang", host="source").collect()
    code = lambda c: {"en-GB": "en", "und": None}.get(c, c)
    same_languages(got, brute.languages([(k, t, code(l), *parts(h)) for k, t, l, h, _ in rows]), "doc_id")
    assert language.identify_languages(table.where("false"), declared="lang", host="source").count() == 0
    # A key twice, or none, gives a row each.
    twice = language.identify_languages(table.unionByName(table.where("doc_id < 3")).unionByName(table.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))),
                                        declared="lang", host="source").collect()
    assert sorted(r["doc_id"] for r in twice if r["doc_id"] is not None and r["doc_id"] < 3) == [0, 0, 1, 1, 2, 2] and sum(r["doc_id"] is None for r in twice) == 1


def test_page_languages(spark):
    rng = random.Random(4)
    rows = []
    for i, l in enumerate(rng.choices(list(SYLLABLES), k=80)):
        said = rng.choice([l, l, None, "it"])
        tag = rng.choice([f'<HTML class=x lang="{said}-XX">', f"<html lang = {said}>"]) if said else "<html>"
        rows.append((i, f"http://u@h{rng.randrange(4)}.{l}:80/{i}?q=<", f"<!-- no --><script>var the = 1</script>{tag}<p>{words(rng, l, rng.choice([2, 30]))}</p> < open", said))
    rows += [(100, None, None, None), (101, "no address", "", None), (102, "ftp://h0.en", "<" * 1000, None)]
    table = prepare(spark).createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = language.identify_languages(table, key="page_id", text="html", url="url", markup=True).collect()
    host = lambda u: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1]
    same_languages(got, brute.languages([(k, t, said, *parts(host(u))) for k, u, t, said in rows]), "page_id")


def test_markup_in_one_pass():
    rng = random.Random(5)
    pieces = ["<", ">", "<!--", "-->", "<script>", "</script>", "<SCRIPT x", "</script  >", "<style>", "</style", "<scripty>", "a", " ", "--", "/"]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert language.without_markup(text) == brute.TAGS.sub(" ", text), text
    for odd in ("<", "<script>", "<!--", "<style", "</script ", "<script>x</script"):
        assert len(language.without_markup(odd * (2_000_000 // len(odd)))) >= 0  # no time that grows as the square


def test_odd_markup_in_time(spark):
    odd = ["<html " * 50_000, "<html lang=" + " " * 300_000 + "!", "<html lang" * 40_000, "<html lang='" + " '" * 100_000]
    table = prepare(spark).createDataFrame(list(enumerate(odd)), "page_id long, html string")
    assert language.identify_languages(table, key="page_id", text="html", markup=True).where("declared is not null").count() == 0


@pytest.mark.parametrize("labelled", [True, False])
def test_importance(spark, labelled):
    rng = random.Random(6)
    docs = [(i, words(rng, "en" if i % 3 else "de", rng.choice([1, 8, 60])) + rng.choice(["", " !? x2"]), "a", 1) for i in range(160)]
    docs += [(500, None, "b", 1), (501, "", "b", 1), (502, words(rng, "en", 20_000), "b", 1), (None, "no key", "b", 1), docs[4], docs[4]]
    docs += [(600 + i, docs[7][1], "c", 1) for i in range(50)]
    labels = [(i, int(i % 3 > 0), int(i % 11 == 1)) for i in range(120)] + [(4, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None), (900, 1, 0)]
    table = prepare(spark).createDataFrame(docs, "doc_id long, text string, target string, log_weight int")
    found = importance.quality_sample(table, spark.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int")).collect()
    want = brute.sample([d[:2] for d in docs], labels if labelled else [], *noise_of(spark, [d[0] for d in docs]))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["log_weight"], r["kept"]) for r in found), key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[0] == w[0] and g[2] == w[2] and g[1] == pytest.approx(w[1], rel=1e-9, abs=1e-6)
    assert importance.quality_sample(table.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def chain(spark, docs, labels):
    """Keys each of the first three stages keeps, by plain Python; docs are (key, text, lang, source) with distinct keys."""
    half, noise = noise_of(spark, [d[0] for d in docs])
    good = {k for k, _, kept in brute.sample([d[:2] for d in docs], labels, half, noise) if kept}
    docs = [d for d in docs if d[0] in good]
    said = brute.languages([(k, t, l, *parts(s)) for k, t, l, s in docs])
    fine = {k for k, v in said.items() if v[4]}
    docs = [d for d in docs if d[0] in fine]
    return good, fine, brute.first_of_groups([d[:2] for d in docs], 5, (80, 100))


def test_pipeline(spark):
    table = read_table(spark, FOLDER, "documents")
    docs = [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in read_table(spark, FOLDER, "labels").select("doc_id", "quality", "toxic").collect()]
    want = chain(spark, docs, labels)
    at = table
    for (name, step), keys in zip(corpus_pipeline.STAGES, want):
        at = stage(step(spark, at, FOLDER), name)
        assert {r[0] for r in at.select("doc_id").collect()} == keys and at.count() == len(keys), name
    tokenizer = Tokenizer.from_file(word_tokenizer_path())
    texts = {d[0]: d[1] or "" for d in docs}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in pieces} == want[-1]
    for k in want[-1]:
        mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == k)
        n = len(tokenizer.encode(texts[k], add_special_tokens=False).ids) + (END_ID is not None)
        assert [s for s, _, _ in mine] == [sum(x for _, x, _ in mine[:i]) for i in range(len(mine))]
        assert sum(x for _, x, _ in mine) == n and {d for _, _, d in mine} == {n}


def test_pipeline_on_odd_rows(spark):
    table = read_table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, None), (-2, None, "en", "s", None)], table.schema)
    rows = table.unionByName(odd).unionByName(table.where("doc_id < 5")).withColumn("target", F.lit(1)).withColumn("_curve", F.lit("x"))
    at = rows
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = stage(step(spark, at, FOLDER), name)
        assert at.columns == rows.columns
    assert at.where("doc_id >= 0").count() == at.where("doc_id >= 0").select("doc_id").distinct().count() > 0
    nothing = table.where("false")
    for name, step in corpus_pipeline.STAGES:
        nothing = step(spark, nothing, FOLDER)
        assert nothing.count() == 0, name
