"""Mixing against exact shares, a plain sequential draw and the distribution it promises."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelbook.llm import mixing
from reelbook.llm.common import prepare

SCHEMA = "doc_id long, text string, source string, size long, w double, target string"


def targets_of(sizes, weights=(5, 2, 1), copies=3):
    """Shares with the excess dealt again, step by step, as fractions."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while len(fixed) < len(order):
        left, share = total - sum(fixed.values()), sum(w for s, w in weight.items() if s not in fixed)
        over = [s for s in order if s not in fixed and copies * sizes[s] <= Fraction(left * weight[s], share)]
        if not over:
            return fixed | {s: Fraction(left * weight[s], share) for s in order if s not in fixed}
        fixed |= {s: Fraction(copies * sizes[s]) for s in over}
    return fixed


def size_of(text):
    return len(re.findall("[^ \t-\r]+", text or ""))


def brute(rows, seed="mix", fills=mixing.FILLS):
    """The ranking walked through one document at a time."""
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += size_of(text)
    targets, out = targets_of(sizes), []
    for source, target in targets.items():
        mine = [(k, size_of(t)) for k, t, s, *_ in rows if s == source]
        target = float(target)
        each = target / sizes[source] if sizes[source] else 0.0
        whole, chance = int(each), each - int(each)
        able, copies, rest = [], [whole if n else 0 for _, n in mine], target - whole * sizes[source]
        for i, (k, n) in enumerate(mine):
            digest = hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
            u = (int(digest[:13], 16) + 0.5) / 2**52
            if n and chance > 0:
                able.append(((u / (1 - u)) * ((1 - chance) / chance), digest, n, i))
        able.sort()
        at, unfit = 0, None
        for _ in range(1 + fills):
            fits, unfit = rest, None
            while at < len(able):
                n, i = able[at][2:]
                at += 1
                if n <= fits and n > rest:
                    unfit = (n, i)
                    break
                if n <= fits:
                    rest -= n
                    copies[i] += 1
        if unfit and 2 * rest >= unfit[0]:
            copies[unfit[1]] += 1
        out += [(k, source, n, sizes[source], target, c, c * n) for (k, n), c in zip(mine, copies)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(3)
    made = []
    for i in range(400):
        n = int(min(rnd.pareto(1.1) * 20, 5000))
        made.append((i, "w\x0b" * n, ["hot", "hot", "b", "é", "z", "tiny"][i % 6] if i % 50 else None, i, 1.0, "t"))
    made = [r for r in made if r[2] != "tiny" or r[0] < 30]
    odd = [(1000, None, "hot", 0, None, ""), (1001, " \t\n", "b", 0, None, ""), (1002, "\x1c \xa0", "b", 0, 1.0, ""), (None, "a b", None, 0, 1.0, ""), (1003, "x", "none", 0, 1.0, ""), (1004, "", "void", 0, 1.0, "")]
    return made + odd + made[:5]


def test_mix_equals_a_walk_through_the_ranking(spark, rows):
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    found = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    assert found == brute(rows)
    assert Counter(map(tuple, mixing.mix_sources(docs.repartition(5, "text")).collect())) == found
    taken, target = Counter(), {}
    for (_, source, n, _, t, c, words), times in found.items():
        assert c <= 3 and words == c * n
        taken[source] += words * times
        target[source] = t
    assert all(abs(taken[s] - t) <= max(5, 0.05 * t) for s, t in target.items())


def test_small_slices_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 7)
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, mixing.mix_sources(docs, seed="other").collect())) == brute(rows, seed="other")


def test_targets_deal_the_excess_again(spark):
    sizes = {"a": 1, "b": 2, "c": 1000, "d": 30, "e": 0, "é": 5000, None: 17}
    table = prepare(spark).createDataFrame([(s, n) for s, n in sizes.items()], "_source string, size long")
    found = {r["_source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(table, (5, 2, 1), 3).collect()}
    assert found == {s: (sizes[s], float(t)) for s, t in targets_of(sizes).items()}
    big = {"x": 10**15, "y": 3 * 10**14, "z": 7}
    table = spark.createDataFrame(list(big.items()), "_source string, size long")
    assert {r["_source"]: r["target"] for r in mixing.source_targets(table, (5, 2, 1), 3).collect()} == {s: float(t) for s, t in targets_of(big).items()}


def test_weights_set_the_chances_of_documents(spark):
    rows = [(i, "a b c d", "one" if i % 2 else "two", 0, [1.0, 2.0, 4.0, None, -1.0][i % 5], "") for i in range(3000)]
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    found = mixing.mix_sources(docs, weights=(1, 3), weight="w").collect()
    mean = defaultdict(list)
    taken, target = Counter(), {}
    for r in found:
        mean[r["source"], r["doc_id"] % 5].append(r["copies"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    mean = {k: np.mean(v) for k, v in mean.items()}
    assert target == {"one": 3000.0, "two": 9000.0} and all(abs(taken[s] - t) <= 4 for s, t in target.items())
    # 3000 words of source ``one`` over weights 1, 2, 4 in equal parts: 5/14, 10/14 and 20/14 copies.
    assert [abs(mean["one", i] - 5 / 14 * 2**i) < 0.08 for i in range(3)] == [True] * 3
    # Source ``two`` has 15/14, 30/14, and 60/14 capped at 3; the rest is raised: 9000 = 4 * 300 * (3 c + 3), so 1.5 and 3 (at 3).
    assert abs(mean["two", 0] - 1.5) < 0.1 and mean["two", 1] == mean["two", 2] == 3
    assert all(mean[s, i] == 0 for s in target for i in (3, 4))


def test_odds_rank_by_inclusion(spark):
    """With document chances p, the share of seeds that take a document is near p."""
    rows = [(i, "w", "s", 0, float(w), "") for i, w in enumerate([1] * 10 + [3] * 10)] + [(99, "w " * 60, "t", 0, 0.0, "")]
    docs = prepare(spark).createDataFrame(rows, SCHEMA)
    n = Counter()
    for seed in range(12):
        for r in mixing.mix_sources(docs, weights=(1, 7), weight="w", seed=str(seed), fills=0).where("source = 's'").collect():
            n[r["doc_id"] // 10] += r["copies"]
            assert r["copies"] <= 1
    assert n[0] + n[1] == 12 * 10 and abs(n[0] / 120 - 0.25) < 0.12 and abs(n[1] / 120 - 0.75) < 0.12


def test_no_rows_and_no_words(spark):
    docs = prepare(spark).createDataFrame([(1, None, "a", 0, 1.0, ""), (2, " ", None, 0, 1.0, "")], SCHEMA)
    assert mixing.mix_sources(docs.where("false")).collect() == []
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == [(1, "a", 0, 0, 0.0, 0, 0), (2, None, 0, 0, 0.0, 0, 0)]
