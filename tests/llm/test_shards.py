"""Shards on disk: whole rows, and ranges that let a reader skip files."""

import re
from collections import Counter

from pyspark.sql import functions as F

from reelbook.llm import hilbert
from reelbook.llm.common import prepare


def test_shards_hold_whole_rows_and_their_ranges(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 900), ["en", "de", None][i % 3], f"s{i % 8}", i * 0.5) for i in range(600)] + [(5, None, "en", "s1", 1.0)] * 4
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, shard double")
    back, ranges = hilbert.write_shards(docs, 8, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/rows")
    assert Counter(map(tuple, stored.select(docs.columns).collect())) == Counter(rows)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    found = {r["_shard"]: r for r in spark.read.parquet(f"{tmp_path}/ranges").collect()}
    assert sorted(found) == list(range(8)) and sum(r["rows"] for r in found.values()) == len(rows)
    for r in back.select("*", size.alias("n")).collect():
        f = found[r["_shard"]]
        assert f["min_size"] <= r["n"] <= f["max_size"] and f["min_source"] <= r["source"] <= f["max_source"]
        assert r["lang"] is None or f["min_lang"] <= r["lang"] <= f["max_lang"]
    # Some shards can be skipped when one source, or the long texts, are wanted.
    assert sum(f["min_source"] <= "s7" <= f["max_source"] for f in found.values()) < 8
    assert sum(f["max_size"] >= 880 for f in found.values()) < 8
    assert ranges.count() == 8


def test_one_odd_value_leaves_the_order_of_strings(spark, tmp_path):
    rows = [(i, "text", "en", f"https://site{i % 40:02}.example") for i in range(800)] + [(900, "text", "en", "ftp://z"), (901, "text", "en", None), (902, "", None, "é")]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")
    back, ranges = hilbert.write_shards(docs, 8, str(tmp_path))
    meet = [sum(r["min_source"] <= f"https://site{s:02}.example" <= r["max_source"] for r in ranges.collect()) for s in range(40)]
    assert sum(meet) <= 40 * 2.5 and back.count() == len(rows)
    # A reader opens the shards that can hold the rows, and finds all of them.
    for wanted, test in (({"source": ("https://site07", "https://site09~")}, lambda r: "https://site07" <= (r[3] or "") <= "https://site09~"),
                         ({"source": ("ftp://z", "ftp://z"), "size": (0, 10)}, lambda r: r[3] == "ftp://z"), ({"size": (0, 0)}, lambda r: r[1] == ""),
                         ({"lang": ("zz", "zz")}, lambda r: False), ({}, lambda r: True)):
        found = hilbert.read_shards(spark, str(tmp_path), **wanted)
        assert sorted(r["doc_id"] for r in found.collect()) == [r[0] for r in rows if test(r)]
    opened = hilbert.read_shards(spark, str(tmp_path), source=("https://site07", "https://site07~"))
    assert re.search(r"PartitionFilters: \[[^\]]*shard#", opened._jdf.queryExecution().executedPlan().toString())
    assert opened.select(F.input_file_name()).distinct().count() <= 4


def test_cells_of_strings_are_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "RUN_ROWS", 7)  # several runs of distinct values
    values = ["a"] * 50 + [f"b{i:03}" for i in range(45)] + ["\U0001F600", "￿", "", None, None]
    table = prepare(spark).createDataFrame([(v,) for v in values], "v string")
    known = sorted((v for v in values if v is not None), key=lambda v: v.encode())
    first = {v: known.index(v) for v in known}
    bounds = hilbert._string_bounds(table, "v", 8)
    cell = {v: sum(b.encode() <= v.encode() for b in bounds) for v in known}
    want, at = {}, {}
    for v in sorted(first, key=first.get):
        want[v] = first[v] * 7 // len(known) + 1
        at.setdefault(want[v], v)
    assert cell == want and len(bounds) == 7 and set(bounds) == set(at.values())
    assert hilbert._string_bounds(table.where("v is null"), "v", 8) == []


def test_runs_end_where_bytes_do(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(hilbert, "RUN_BYTES", 200_000)
    rows = [(i, "x" * (20_000 if i % 10 == 0 else 20), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stored, put = [], hilbert._stored
    monkeypatch.setattr(hilbert, "_stored", lambda df, folder, **by: stored.append(put(df, folder, **by)) or stored[-1])
    back, _ = hilbert.write_shards(docs, 8, str(tmp_path))
    runs = stored[0].groupBy("_run").agg(F.sum("_size").alias("bytes")).collect()
    assert len(runs) >= 8 and max(r["bytes"] for r in runs) <= 3 * 200_000
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert sum(counts) == 1000 and max(counts) - min(counts) <= 1
