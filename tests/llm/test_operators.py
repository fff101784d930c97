"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows."""

import gzip
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelbook.llm import bpe, cosine, hilbert, huffman, impact, importance, jaccard, language, packing, warc
from reelbook.llm.common import components, prepare
from reelbook.llm.shingles import shingle_set, word_hashes
from reelbook.llm.tokens import library_encoder, word_tokenizer_path

WORDS = "alpha beta gamma delta über straße ça été niño it's 42 x² — 日本 hahaha the and".split()


def text_of(seed, n):
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(WORDS, n))


def near(text, at, word="changed"):
    words = text.split(" ")
    words[at] = word
    return " ".join(words)


BASE = text_of(1, 120)
TEXTS = [
    BASE, near(BASE, 5), near(near(BASE, 5), 115), BASE, "", None, "one", "ONE", "two words", "  \t\n ", text_of(2, 3), text_of(3, 400),
    text_of(4, 30_000), near(text_of(3, 400), 200), "<|endoftext|> and <|x", "x" * 3000, "\x1c\x85\xa0 İΣ ǅ", "a b c d", "A  b\tc d",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 50, t, ["en", "de", None][i % 3], ["a.example.org", None, "b"][i % 3], i, 0.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    # Extra columns with names the operators use themselves.
    return prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, key long, start double")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def empty(docs):
    return docs.where("false")


def links_of(sets, similar):
    """Least member each member reaches, by comparing all pairs."""
    above = {k: k for k in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if similar(sets[a], sets[b]):
                one, other = top(a), top(b)
                above[max(one, other)] = min(one, other)
    return {k: top(k) for k in keys}


def test_curve_visits_every_cell_by_unit_steps(spark):
    cells = spark.range(512).select(*[(F.col("id") / 8**d % 8).cast("long").alias(f"c{d}") for d in range(3)])
    rows = cells.select("*", hilbert.curve_index([F.col(f"c{d}") for d in range(3)], 3).alias("i")).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(rows, rows[1:]))


def test_hilbert_shards(docs, plain):
    rows = hilbert.hilbert_shards(docs, 6).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in plain
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(6)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert hilbert.hilbert_shards(empty(docs), 6).count() == 0


def test_backtracking_equals_library(tokenizer):
    rnd = np.random.default_rng(5)
    own, library = bpe.codec(), library_encoder()
    letters = [chr(i) for i in range(256)] + list("aeiounsthx' ") * 20 + ["é", "œ", "́", "<|endoftext|>", "日"]
    for _ in range(1500):
        text = "".join(rnd.choice(letters, rnd.integers(0, 40)))
        want = ids_of(tokenizer, text)
        assert np.frombuffer(own.encode(text), "<u2").tolist() == want
        assert np.frombuffer(library(text), "<u2").tolist() == want


def test_bpe_round_trip(docs, plain, tokenizer):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for k, t in plain:
        ids = ids_of(tokenizer, t)
        want[k, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == want
    texts = Counter(map(tuple, bpe.decode_ids(bpe.encode_texts(docs)).collect()))
    assert texts == Counter((k, tokenizer.decode(ids_of(tokenizer, t), skip_special_tokens=False)) for k, t in plain)
    assert bpe.round_trip(empty(docs)).count() == 0


def test_packing(docs, plain, tokenizer):
    rows = packing.pack_documents(docs, length=64, window=2).collect()
    whole = {(k, crc(ids)): ids for k, t in plain for ids in [[*ids_of(tokenizer, t), 2]]}
    by_key = {k: ids for (k, _), ids in whole.items()}
    line = defaultdict(list)
    for r in rows:
        assert crc(by_key[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and r["doc_tokens"] == len(by_key[r["doc_id"]])
        line[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids_of(tokenizer, t)) + 1 for _, t in plain)
    assert sorted(line) == list(range(len(line)))
    for s, pieces in line.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        assert sum(pieces[-1]) == 64 or s == len(line) - 1
    assert packing.pack_documents(empty(docs)).count() == 0


def test_mixture_holds_in_every_window():
    totals = [50_000, 7, 0, 20_001, 999]
    plan = packing.Mixture(totals, 64, 8)
    for w in range(plan.windows):
        took = plan.given(w + 1) - plan.given(w)
        assert all(abs(t - n / plan.windows) <= 1 for t, n in zip(took, totals))
    assert plan.given(plan.windows).tolist() == totals


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rnd.normal(size=8).round(1)]) for i in range(300)]
    odd = [(300, None), (350, [float("nan")] * 8), (400, [None] * 8), (450, []), (None, [1.0] * 8), (0, vectors[0][1]), (500, vectors[50][1])]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in impact.exact_top_k(rows).collect())
    good = dict(vectors) | {500: vectors[50][1]}
    whole = {k: np.floor(np.array(v) * 256).astype(int) for k, v in good.items()}
    want = []
    for q in sorted(k for k in good if k % 50 == 0):
        best = sorted((-int(v @ whole[q]), k) for k, v in whole.items() if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert found == want
    assert impact.exact_top_k(rows.where("false")).count() == 0
    assert impact.exact_top_k(rows.where("vec_id = 0")).count() == 0


def test_warc(spark):
    long = "é" * 600
    pages = [(1, "http://a/", long), (2, None, long), (3, "http://b\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", "z" * 2_000_000), (9, "u", "a\r\n\r\nWARC/1.0\r\n")]
    rows = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    found = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(rows).collect()}
    for k, _, html in pages:
        body = (html or "").encode()
        again = html == long and k != 7
        assert found[k] == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 7 if again else None)
    assert warc.archive_round_trip(rows.where("false")).count() == 0


def test_cosine(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + 0.05 * rnd.normal(size=16)).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(5)] + [(300, [0.0] * 16), (301, None), (302, [float("inf")] * 16), (303, [1.0])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    usable = {k: np.array(v) for k, v in vectors if k < 300}
    like = lambda a, b: a @ b / np.sqrt(a @ a * (b @ b)) >= 0.95
    groups = links_of(usable, like)
    counts = {k: sum(like(usable[k], usable[j]) for j in usable if j != k) for k in usable}
    for r in cosine.near_duplicate_vectors(rows).collect():
        k = r["vec_id"]
        assert tuple(r)[1:] == (counts.get(k, 0), groups.get(k, k), groups.get(k, k) == k)
    assert cosine.near_duplicate_vectors(rows.where("false")).count() == 0


def test_code_lengths_are_best_and_limited():
    rnd = np.random.default_rng(6)
    counts = {int(i): int(c) for i, c in enumerate(np.r_[1, 1, 2, 4, 8, 16, 32, 64, 0, rnd.integers(1, 5, 8)])}
    lengths = huffman.code_lengths(counts, 6)
    assert max(lengths.values()) <= 6 and sum(2.0**-n for n in lengths.values()) <= 1 and set(lengths) == {i for i, c in counts.items() if c}
    free = huffman.code_lengths(counts, 40)
    import heapq

    heap, cost = [c for c in counts.values() if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert sum(counts[i] * n for i, n in free.items()) == cost
    assert huffman.code_lengths({9: 5}) == {9: 1} and huffman.code_lengths({}) == {}


def test_coded_files(docs, plain, tokenizer, tmp_path):
    tokens = packing.token_rows(docs, source=None).cache()
    files = huffman.write_coded(tokens, str(tmp_path), file_ids=5000)
    assert files.count() > 1
    found = [tuple(r) for r in huffman.read_coded(files).collect()]
    start, want = 0, []
    for k, ids in sorted((k, [*ids_of(tokenizer, t), 2]) for k, t in plain):
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(found) == sorted(want)
    assert huffman.coded_round_trip(empty(docs)).count() == 0


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def test_shingle_hashes():
    for text in filter(None, TEXTS):
        assert len(shingle_set(text, 4)) == len(shingles(text, 4))
    assert len(shingle_set("the and and the x and the the and", 4)) == 6
    long = "word " * 200_000
    assert len(set(word_hashes(long).tolist())) == 1 and len(word_hashes(long)) == 200_000


@pytest.mark.parametrize("words,least", [(4, (85, 100)), (5, (80, 100))])
def test_near_duplicates(spark, docs, words, least):
    rnd = np.random.default_rng(8)
    more, shared = [], text_of(77, 60)
    for g in range(12):
        base = text_of(100 + g, 90)
        for i in range(9):
            text = base
            for _ in range(i % 4):
                text = near(text, int(rnd.integers(0, 90)), f"w{rnd.integers(99)}")
            more.append((1000 + 20 * g + i, text + (" " + shared if g % 3 == 0 else "")))
    more += [(5000 + i, shared + " " + text_of(200 + i, 8)) for i in range(40)]
    rows = docs.select("doc_id", "text").distinct().unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sets = {r["doc_id"]: shingles(r["text"], words) for r in rows.collect()}
    want = links_of(sets, lambda a, b: bool(a and b) and least[1] * len(a & b) >= least[0] * len(a | b))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(rows, words=words, least=least).collect()}
    assert found == {k: (len(sets[k]), want[k]) for k in sets}


def test_near_duplicates_edges(docs):
    kept = jaccard.first_of_each_group(docs)
    assert kept.columns == docs.columns
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert jaccard.near_duplicates(empty(docs)).count() == 0
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard.near_duplicates(nameless).count() == docs.count()


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("reelbook.llm.common.TASK_LINKS", 20)
    chain = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    apart = spark.createDataFrame([(500, 700), (600, 700)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(chain.unionByName(apart), "test").collect()}
    assert found == {**dict.fromkeys(range(101), 0), 500: 500, 600: 500, 700: 500}


def test_language(spark, docs):
    data = {"en": "the cat and the dog went with this house that they have ", "de": "der hund und die katze sind nicht mit dem haus das sie haben ",
            "fr": "le chien et la chatte sont avec cette maison que vous avez ", "es": "el perro y la gata no son con esta casa que ellos tienen "}
    rows = [(i, data[x] * 3, x, f"http://h{i % 3}.example.{x}/p") for i, x in enumerate(list(data) * 10)]
    rows += [(100, "12345 --- 678", "en", "http://h.example.en/"), (101, None, "de", None), (102, data["de"] * 3, "xx", "bad"), (103, data["fr"] * 3, "en", "http://h0.example.fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    found = {r["doc_id"]: r for r in language.identify_languages(table, declared="lang", url="url").collect()}
    assert all(found[i]["language"] == x and found[i]["accepted"] for i, _, x, _ in rows[:40])
    assert found[102]["language"] == "de" and found[103]["language"] == "fr"
    assert not found[100]["accepted"] and not found[101]["accepted"]
    assert language.identify_languages(empty(docs), declared="lang", host="source").count() == 0


def test_importance(spark, docs):
    good, bad = "calm river under green hills while birds sing softly".split(), "buy cheap pills now click here win cash".split()
    rnd = np.random.default_rng(9)
    rows = [(i, " ".join(rnd.choice(good if i % 4 else bad, 40))) for i in range(400)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in importance.quality_sample(table, marks).collect()}
    held_out = [i for i, _ in rows if i >= 200]
    assert sum(found[i] == bool(i % 4) for i in held_out) >= 0.97 * len(held_out)
    assert importance.quality_sample(docs, marks.where("false")).where("kept").count() == docs.count()
    assert importance.quality_sample(empty(docs), marks).count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW_VALUES", 5)
    values = [float(x) for x in np.random.default_rng(2).normal(size=300).round(2)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 150, 300):
        assert importance.kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]


def test_cut_archives_are_refused(spark, tmp_path):
    engine, data = zlib.compressobj(4, zlib.DEFLATED, 31), b""
    records = [warc.record(i, f"http://h/{i}", b"%d" % i * 9, hashlib.sha1(b"%d" % i * 9).hexdigest(), "response", None) for i in range(6)]
    for r in records:
        data += engine.compress(r) + engine.flush(zlib.Z_SYNC_FLUSH)
    data += engine.flush()
    read = lambda b: list(warc.records_of(warc.inflated(io.BytesIO(b))))
    assert read(data) == records and read(data + gzip.compress(records[0])) == records + records[:1]
    for cut in range(len(data)):
        with pytest.raises((ValueError, zlib.error)):
            read(data[:cut])
    with pytest.raises((ValueError, zlib.error)):
        read(data + gzip.compress(records[0])[:-1])
    (tmp_path / "whole.warc.gz").write_bytes(data)
    listed = prepare(spark).createDataFrame([(f"{tmp_path}/whole.warc.gz", 6)], "path string, n_records long")
    assert warc.normalise(listed, str(tmp_path / "out")).collect()[0]["n_records"] == 6
    with pytest.raises(Exception, match="6 records, not 7"):
        warc.normalise(listed.withColumn("n_records", F.lit(7)), str(tmp_path / "out2"))


def test_repeated_pages_are_records_of_their_own(spark):
    rows = [(1, "u", "p" * 2000), (1, "u", "p" * 2000), (None, None, "p" * 2000), (3, "u", None), (3, "u", "")]
    found = warc.archive_round_trip(prepare(spark).createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in found) == [
        (0, 2000, "revisit", 1), (1, 2000, "response", 0), (1, 2000, "response", 0), (3, 0, "response", 0), (3, 0, "response", 0)]
