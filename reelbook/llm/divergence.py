"""Audit of sources: how far the term distributions of a language's sources lie apart, and by which terms.

Counting is a pipeline of Arrow kernels inside the tasks: lower-case, split, dictionary-encode, group. Partial counts are merged by
Spark, terms of too few documents are dropped, and the rest is dealt to columnar shards, each a part of a language's terms for
two blocks of its sources, in which the divergences of all pairs of sources are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelbook.llm.common import prepare
from reelbook.session import stage

#: What lies between terms: ASCII other than letters (fixed by the definition of a term).
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts a share is counted in, and the count every term has beforehand.
PARTS, BEFOREHAND = 1_000_000_000, 2
#: Rows of partial counts a task holds before it sends them on.
HELD_ROWS = 400_000
#: Rows of a shard, sources of a block, and cells of a shard that are looked at together.
SHARD_ROWS, BLOCK_SOURCES, CELLS = 200_000, 128, 1 << 21
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_VALUES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row per group and term."""
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS)


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Counts of a batch (text, lang, source): a row per group and term, and one without a term per group."""
    text, lang, source = (pc.fill_null(batch.column(i), "") for i in range(3))
    split = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    row, term = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(term, "")
    row, coded = row.filter(real), term.filter(real).dictionary_encode()
    per_doc = pa.table({"row": row, "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    of_lang, of_source = lang.dictionary_encode(), source.dictionary_encode()
    both = of_lang.indices.to_numpy().astype(np.int64) * len(of_source.dictionary) + of_source.indices.to_numpy()
    _, first, of_row = np.unique(both, return_index=True, return_inverse=True)
    cells = pa.table({"group": pa.array(of_row[per_doc["row"].to_numpy()]), "term": per_doc["term"], "n": per_doc["count_all"]})
    counts = cells.group_by(["group", "term"]).aggregate([("n", "sum"), ([], "count_all")])

    def rows(group: np.ndarray, terms: pa.Array, n: pa.Array, docs: pa.Array) -> pa.Table:
        of = pa.array(first[group])
        return pa.table([lang.take(of), source.take(of), terms, n, docs], schema=_COUNTS)

    none = pa.array(np.zeros(len(first), np.int64))
    found = [c.combine_chunks() for c in (counts["term"], counts["n_sum"], counts["count_all"])]
    bare = rows(np.arange(len(first)), pa.nulls(len(first), pa.string()), none, none)
    return pa.concat_tables([rows(counts["group"].to_numpy(), coded.dictionary.take(found[0]), found[1], found[2]), bare])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences of every term in each (lang, source) and the documents there that have it; each group has a row without term."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch_counts(batch))
            rows += held[-1].num_rows
            if rows >= HELD_ROWS:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows >= HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from _merged(held).to_batches(max_chunksize=50_000)

    schema = "lang string, source string, term string, n bigint, docs bigint"
    partial = docs.select("text", "lang", "source").mapInArrow(run, schema)
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(PARTS * (count + BEFOREHAND) / (total + BEFOREHAND * kept)), exactly."""
    above, below = count + BEFOREHAND, np.broadcast_to(total + BEFOREHAND * kept, count.shape)
    if count.size and int(below.max()) >= 1 << 53:
        return np.array([1 + PARTS * int(a) // int(b) for a, b in zip(above.ravel(), below.ravel())], np.int64).reshape(count.shape)
    found, rest = np.zeros(count.shape, np.int64), above
    for _ in range(3):  # three decimal digits at a time stay within 64 bits
        more, rest = np.divmod(rest * 1000, below)
        found = found * 1000 + more
    return found + 1


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)) of shares."""
    return (p - q) ** 2 // (p + q)


def shard_values(key: tuple, counts: pa.Table, groups: pa.Table, most: int) -> pa.Table:
    """What a shard adds: divergence of each pair of sources (once per pair, the lesser name first), best terms of each source.

    ``key`` ends with shard and two blocks of sources; within one block all pairs count, otherwise pairs across. A kept term that neither
    block has adds the same to a pair as any other such term: shard 0 adds that for all kept terms and every shard takes it back
    for those it holds. ``groups`` has lang, source,
    total, lang_total, kept and block; ``counts`` source, term, n, lang_n.
    """
    shard, one, other = (k.as_py() for k in key[-3:])
    groups = groups.sort_by("source")
    sources, blocks = groups["source"].combine_chunks(), groups["block"].to_numpy()
    lang, kept, lang_total = (groups[c][0].as_py() for c in ("lang", "kept", "lang_total"))
    total = groups["total"].to_numpy()
    of = pc.index_in(counts["source"], value_set=sources).to_numpy().astype(np.int64)
    coded = counts["term"].combine_chunks().dictionary_encode()
    term, n = coded.indices.to_numpy().astype(np.int64), counts["n"].to_numpy()
    by_term = np.argsort(term, kind="stable")
    of, term, n = of[by_term], term[by_term], n[by_term]
    share = shares(n, total[of], kept) if len(n) else n
    summed = np.zeros((len(sources), len(sources)), np.int64)
    least = shares(np.zeros(len(sources), np.int64), total, kept) if kept else np.ones(len(sources), np.int64)
    width = max(1, CELLS // len(sources))
    for lo in range(0, len(coded.dictionary), width):
        cut = slice(*np.searchsorted(term, [lo, lo + width]))
        p = np.repeat(least[:, None], min(width, len(coded.dictionary) - lo), axis=1)
        p[of[cut], term[cut] - lo] = share[cut]
        for s in range(len(sources) - 1):
            summed[s, s + 1 :] += spread(p[s], p[s + 1 :]).sum(axis=1)
    summed += ((kept if shard == 0 else 0) - len(coded.dictionary)) * spread(least[:, None], least)
    a, b = np.triu_indices(len(sources), 1)
    if one != other:
        across = blocks[a] != blocks[b]
        a, b = a[across], b[across]
    parts = [(sources.take(pa.array(a)), "pair", sources.take(pa.array(b)), summed[a, b])]
    if one == other and len(n):
        q = shares(counts["lang_n"].to_numpy()[by_term], np.int64(lang_total), kept)
        above = np.flatnonzero((n > 0) & (share > q))
        rows = pa.table({"of": of[above], "value": spread(share[above], q[above]), "term": coded.dictionary.take(pa.array(term[above]))})
        rows = rows.sort_by([("of", "ascending"), ("value", "descending"), ("term", "ascending")])
        at = rows["of"].to_numpy()
        first = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) < most)
        best = rows.take(pa.array(first))
        parts.append((sources.take(best["of"].combine_chunks()), "term", best["term"].combine_chunks(), best["value"].to_numpy()))
    return pa.concat_tables([
        pa.table([pa.repeat(lang, len(x)), x, pa.repeat(part, len(x)), item, pa.array(value)], schema=_VALUES) for x, part, item, value in parts
    ])


def audit_sources(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """Divergences of the sources of each language: lang, source, part, item, value, rank.

    Part ``pair`` has a row for every other source of the language, part ``term`` the ``most_terms`` terms by which a source stands out from
    its language. Null text, lang and source count as empty ones. A language keeps the terms of at least ``least_docs`` of its rows;
    one without such terms has pairs of value 0. Repeated rows are documents of their own; ties go to the lesser item in UTF-8 order.
    Without rows there is no row.
    """
    prepare(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = stage(term_counts(plain), "terms")
    terms = counts.where(F.col("term").isNotNull())
    wanted = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    wanted = stage(wanted.drop("docs"), "kept-terms")
    kept = stage(terms.select("lang", "source", "term", "n").join(wanted, ["lang", "term"]), "kept-counts")
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = stage(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "rows"]), "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("rows").alias("rows"), F.count("*").alias("sources"))
    size = wanted.groupBy("lang").agg(F.count("*").alias("kept"))
    shard_count = F.greatest(F.ceil(F.col("rows") / SHARD_ROWS), F.lit(1))
    of_lang = stage(of_lang.join(size, "lang", "left").select(
        "lang", "lang_total", F.coalesce("kept", F.lit(0)).alias("kept"), shard_count.alias("shards"),
        F.ceil(F.col("sources") / BLOCK_SOURCES).alias("blocks"),
    ), "languages")
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    # A block of sources meets every block, itself included; a pair of blocks has one name.
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("_with")
    tile = [F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("other")]
    cells = kept.join(of_lang.select("lang", "shards", "blocks"), "lang").withColumn("block", block).select(
        "lang", "source", "term", "n", "lang_n", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "block", meets
    ).select("lang", "shard", *tile, "source", "term", "n", "lang_n")
    sides = groups.select("lang", "source", "total").join(of_lang, "lang").withColumn("block", block).select("*", meets).select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"), *tile, "source", "total", "lang_total", "kept", "block")
    keys = ["lang", "shard", "one", "other"]

    def values(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return shard_values(key, left, right, most_terms)

    found = stage(cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(values, "lang string, source string, part string, item string, value bigint"), "shards")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    swapped = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(swapped).unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms))


def twin_sql(least_docs: int = 10, most_terms: int = 10) -> str:
    """The audit of ``documents`` as one DuckDB statement."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = f"1 + ({PARTS}::hugeint * ({{n}} + {BEFOREHAND})) // ({{total}} + {BEFOREHAND} * v)"
    return rf"""
    with docs as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
                         translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as text from documents),
    found as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
    kept as (select lang, term from found group by lang, term having count(distinct row) >= {least_docs}),
    sizes as (select lang, count(*) as v from kept group by lang),
    counts as (select lang, source, term, count(*)::hugeint as n from found join kept using (lang, term) group by lang, source, term),
    lang_counts as (select lang, term, sum(n) as n from counts group by lang, term),
    groups as (select g.lang, g.source, coalesce(sum(n), 0) as total from (select distinct lang, source from docs) g
               left join counts c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
    langs as (select lang, sum(total) as total from groups group by lang),
    p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, {share.format(n='coalesce(c.n, 0)', total='g.total')} as p
          from groups g join kept k on k.lang = g.lang join sizes s on s.lang = g.lang
          left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    q as (select l.lang, l.term, {share.format(n='l.n', total='t.total')} as q from lang_counts l join langs t using (lang) join sizes s using (lang)),
    pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
              from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by 1, 2, 3),
    valued as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
               from groups g join groups h on h.lang = g.lang and h.source <> g.source
               left join pairs x on x.lang = g.lang and x.source = g.source and x.item = h.source
               union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p join q using (lang, term) where n > 0 and p > q)
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (
        select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from valued)
    where part = 'pair' or rank <= {most_terms}"""
