"""Divergence of sources against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelbook.llm import divergence
from reelbook.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, term string, n double"
TERMS = "alpha Beta gamma DELTA über Über 日本 x a-b c3d e".split()


def brute(rows, least=10, most=10):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            f = {o: sum((share[s][t] - share[o][t]) ** 2 // (share[s][t] + share[o][t]) for t in kept) for o in sources if o != s}
            out += [(lang, s, "pair", o, v, i + 1) for i, (o, v) in enumerate(sorted(f.items(), key=lambda x: (-x[1], x[0].encode())))]
            f = {t: (share[s][t] - whole[t]) ** 2 // (share[s][t] + whole[t]) for t in kept if counts[lang, s][t] and share[s][t] > whole[t]}
            out += [(lang, s, "term", t, v, i + 1) for i, (t, v) in enumerate(sorted(f.items(), key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(11)
    made = []
    for i in range(300):
        words = rnd.choice(TERMS, rnd.integers(0, 25)).tolist() + [f"own{'abcdefghij'[i % 7]}"] * int(rnd.integers(0, 3))
        made.append((i, [" ", "\n", "7", "_"][i % 4].join(words), ["en", "de", None, ""][i % 4], [f"s{i % 9}", "hot", None, "hot"][i % 11 % 4], "t", 0.5))
    odd = [(900, None, "en", "bare", "", 0.0), (901, "", "lone", "only", "", 0.0), (902, "123 .,\x7f", "two", "a", "", 0.0), (None, "zz", "two", "é", "", 0.0), (903, "gamma " * 40_000, "en", "hot", "", 0.0)]
    return made + odd + made[:9]


@pytest.mark.parametrize("least", [1, 10])
def test_audit_equals_plain_counting(spark, rows, least):
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    found = sorted(tuple(r) for r in divergence.audit_sources(docs, least_docs=least).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute(rows, least)


def test_small_shards_and_blocks_change_nothing(spark, rows, monkeypatch):
    for name, value in (("SHARD_ROWS", 20), ("BLOCK_SOURCES", 2), ("CELLS", 7), ("HELD_ROWS", 30)):
        monkeypatch.setattr(divergence, name, value)
    docs = prepare(spark).createDataFrame(rows, SCHEMA).repartition(5)
    found = sorted(tuple(r) for r in divergence.audit_sources(docs, most_terms=3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute(rows, most=3)


def test_tables_without_terms(spark, rows):
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    assert divergence.audit_sources(docs.where("false")).collect() == []
    bare = spark.createDataFrame([(1, None, None, "a", "", 0.0), (2, "x", None, None, "", 0.0)], SCHEMA)
    assert sorted(map(tuple, divergence.audit_sources(bare).select("lang", "source", "part", "item", "value", "rank").collect())) == [
        ("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_shares_are_exact_for_large_counts():
    for total in (5, 10**9, 9 * 10**12, (1 << 53) - 100, 10**17):
        count = np.array([0, 1, total // 3, total - 3])
        assert divergence.shares(count, np.int64(total), 20).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 40) for c in count]
    p, q = np.array([10**9 + 1, 7]), np.array([1, 7])
    assert divergence.spread(p, q).tolist() == [10**18 // (10**9 + 2), 0]
