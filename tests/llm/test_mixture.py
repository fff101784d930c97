"""Packing to a target mixture, sequence by sequence."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelbook.llm import packing
from reelbook.llm.common import prepare
from reelbook.llm.tokens import ID


def tokens_of(spark, counts, size=50):
    rows = [(i, s, np.arange(size, dtype=ID).tobytes(), size) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return prepare(spark).createDataFrame([(k, s, bytearray(b), n) for k, s, b, n in rows], "_key long, _source string, ids binary, n_tokens long")


def sequences(pieces, length):
    """Tokens per source of each sequence; pieces lie side by side and hold every token once."""
    line, seen = defaultdict(list), defaultdict(list)
    for r in pieces:
        line[r["sequence_id"]].append((r["offset"], r["length"], r["source"]))
        seen[r["_key"]].append((r["start"], r["length"]))
    found = []
    for s in range(len(line)):
        parts = sorted(line[s])
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert parts[-1][0] + parts[-1][1] == length or s == len(line) - 1
        mix = Counter()
        for _, n, source in parts:
            mix[source] += n
        found.append(mix)
    for parts in seen.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(parts[-1]) == 50 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    return found


def test_every_sequence_keeps_the_sources_shares(spark):
    counts = {"hot": 400, "b": 200, None: 200}
    found = sequences(packing.pack(tokens_of(spark, counts), length=512).collect(), 512)
    assert all(abs(mix[s] - 512 * n / 800) <= 3 for mix in found[:-1] for s, n in counts.items())


def test_target_sets_the_mixture_until_a_source_ends(spark):
    counts = {"hot": 400, "b": 200, "c": 200, None: 20}
    found = sequences(packing.pack(tokens_of(spark, counts), length=512, target={"hot": 1, "b": 2, "c": 1}).collect(), 512)
    # b ends after 10,000 of its tokens, when 20,000 are placed; then hot and c share evenly until c ends.
    for mix in found[: 20_000 // 512 - 1]:
        assert abs(mix["b"] - 256) <= 3 and abs(mix["hot"] - 128) <= 3 and abs(mix["c"] - 128) <= 3
    for mix in found[20_000 // 512 + 2 : 30_000 // 512 - 1]:
        assert abs(mix["hot"] - 256) <= 3 and abs(mix["c"] - 256) <= 3
    assert sum((m[None] for m in found[-4:]), 0) == 1000
    with pytest.raises(ValueError):
        packing.pack(tokens_of(spark, counts), target={"hot": -1})


def test_large_sources_keep_their_queue_among_many(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 6)
    monkeypatch.setattr(packing, "SHARED_QUEUES", 3)
    counts = {"hot": 300} | {f"s{i:02}": 10 for i in range(30)}
    tokens = tokens_of(spark, counts)
    queued, totals, _ = packing._queues(tokens, None)
    assert len(totals) == 6 and totals[0] == 15_000 and sum(totals) == 30_000
    assert queued.where("_queue = 0").agg(F.count("*"), F.min("_source"), F.max("_source")).first() == (300, "hot", "hot")
    found = sequences(packing.pack(tokens, length=512).collect(), 512)
    # Two small sources of their own give 64 tokens at a time.
    assert all(abs(mix["hot"] - 256) <= 2 * 64 for mix in found[:-1])
    assert sum((sum(m.values()) for m in found), 0) == 30_000


def test_small_sources_come_in_pieces_worth_while():
    totals = [100_000] + [300] * 40
    plan = packing.Mixture(totals, 4096, 1, None, 64)
    given = plan.given(np.arange(plan.windows + 1))
    assert (np.diff(given, axis=0) >= 0).all() and given[0].tolist() == [0] * 41 and given[-1].tolist() == totals
    assert all(n >= 44 for q in range(1, 41) for n in np.diff(given[:, q])[np.diff(given[:, q]) > 0])
    exact = np.arange(plan.windows + 1)[:, None] * np.array(totals) / plan.windows
    assert (abs(given - exact) <= 64).all()


def test_no_document_is_lost_at_any_total():
    """Totals from 1e2 to 1e14 ids, with and without sources of no share."""
    rnd = np.random.default_rng(0)
    seen = 0
    for _ in range(400):
        k, total = int(rnd.integers(1, 6)), 10 ** rnd.uniform(2, 14)
        totals = [int(x) for x in rnd.dirichlet(np.ones(k) * rnd.choice([0.3, 1, 5])) * total]
        plan = packing.Mixture(totals, 4096, 1, list(rnd.choice([0, 0.1, 0.3, 1, 2], k)), 64)
        for queue in (q for q in range(k) if totals[q]):
            sizes = [int(min(totals[queue], rnd.integers(1, 20_000))) for _ in range(3)]
            starts = [0, totals[queue] - sizes[1], int(rnd.integers(0, totals[queue] - sizes[2] + 1))]
            for size, pieces in zip(sizes, plan.all_pieces(queue, starts, sizes)):
                ends = [at + take for at, take, _ in pieces]
                assert [at for at, _, _ in pieces] == [0, *ends[:-1]] and ends[-1] == size
                seen += 1
    assert seen > 2000


def test_sources_of_no_share_fill_the_line_once():
    totals = [60_000, 30_000, 10_000, 7_000]
    plan = packing.Mixture(totals, 512, 1, [0.7, 0.3, 0.0, 0.0], 64)
    line = np.zeros(sum(totals), int)
    for queue, total in enumerate(totals):
        for start in range(0, total, 500):
            for _, take, place in plan.pieces(queue, start, 500):
                line[place : place + take] += 1
    assert (line == 1).all()
