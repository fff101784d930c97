"""Phrases against counting every run of words."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reelbook.llm import phrases
from reelbook.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, n long, id string"
WORDS = "new york big apple ÉTÉ été le la x".split()


def brute(rows, least, longest=4, most=2000, absorbed=(80, 100)):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            if any(len(q) > len(p) and absorbed[1] * b >= absorbed[0] * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def table(spark, rows):
    return prepare(spark).createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    made = []
    for i in range(60):
        words = rnd.choice(WORDS, rnd.integers(0, 60), p=[.2, .2, .15, .15, .05, .05, .1, .05, .05]).tolist()
        marks = rnd.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b ", " ! "], len(words), p=[.8, .05, .05, .03, .02, .02, .01, .02]).tolist()
        made.append((i, "".join(w + m for w, m in zip(words, marks)), ["en", "fr", None, "und", ""][i % 5], i, "x"))
    long = " ".join(rnd.choice(WORDS[:4], 30_000))
    odd = [(90, None, "en", 0, None), (91, "", None, 1, ""), (None, " \t ", "en", 2, ""), (92, "...", "fr", 3, ""), (93, "\x1c \x85 a b \x1c \x85 a b", "fr", 4, ""), (94, long, "en", 5, "")]
    return made + odd + odd[-1:] + made[:3]


@pytest.mark.parametrize("least", [2, 30])
def test_phrases_equal_counting_all_runs(spark, rows, least):
    assert sorted(map(tuple, phrases.phrases(table(spark, rows), least=least).collect())) == brute(rows, least)


def test_small_blocks_and_tiles_change_nothing(spark, rows, monkeypatch):
    expected = brute(rows, 3, longest=3, most=5)
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(phrases, "BAND", 40)
    docs = table(spark, rows).repartition(7)
    assert sorted(map(tuple, phrases.phrases(docs, least=3, longest=3, most=5).collect())) == expected


def test_tables_without_phrases(spark, rows):
    assert phrases.phrases(table(spark, rows).where("false")).collect() == []
    assert phrases.phrases(table(spark, [(1, None, None, 0, "")])).collect() == []
    # Frequent words that never meet.
    assert phrases.phrases(table(spark, [(i, "a. b. a", "en", 0, "") for i in range(40)])).collect() == []


def test_tiles_count_pairs_in_every_density(monkeypatch):
    monkeypatch.setattr(phrases, "SIDE", 8)
    rnd = np.random.default_rng(1)
    ranks = np.minimum(rnd.geometric(0.1, 5000), 70) * 1_000_003
    u, v = ranks[:-1], ranks[1:]
    a, b, n, which = phrases.tile_counts(u, v)
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == Counter(zip(u.tolist(), v.tolist()))
    assert (a[which] == u).all() and (b[which] == v).all()
    weights = rnd.integers(1, 9, len(u))
    assert phrases.tile_counts(u, v, weights)[2].tolist() == np.bincount(which, weights).astype(int).tolist()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in phrases.tile_counts(none, none)] == [0] * 4


def test_packed_numbers_come_back():
    rnd = np.random.default_rng(2)
    for size in (0, 1, 500):
        u = np.sort(rnd.integers(0, 40, size)) + (1 << 33)
        v = rnd.integers(0, 1 << 40, size)
        order = np.lexsort((v, u))
        u, v, n = u[order], v[order], rnd.integers(1, 300, size)
        assert [x.tolist() for x in phrases.unpacked_pairs(phrases.packed_pairs(u, v, n), size)] == [u.tolist(), v.tolist(), n.tolist()]


def test_tokens_end_with_their_text():
    data, lengths, first = phrases.tokens_of(pa.array(["Ab c", "", "de", " f.g\th ", "."])[0:])
    ends = np.cumsum(lengths)
    assert [data[e - n : e].tobytes().decode() for e, n in zip(ends, lengths)] == ["ab", "c", "de", "f", "g", "h"]
    assert first.tolist() == [True, False, True, True, True, False]
    assert len(phrases.tokens_of(pa.array([], pa.string()))[1]) == 0


def test_scores_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000_000, 9_100_000_000_000_001, 9_200_000_000_000_003
    units = prepare(spark).createDataFrame([(0, "en", "x y", a, [l], [r])], "id long, lang string, phrase string, f long, pre array<long>, suf array<long>")
    assert phrases._scored(units, 2).first()["score"] == 2_000_000 * a // (l + r)
