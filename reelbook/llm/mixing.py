"""Mixing sources to target weights by Pareto order sampling.

A source is to give a number of words, its target. Every document is first taken as many whole times as its expected number of
copies has units. What is missing is drawn: documents are ranked by random odds divided by inclusion odds (the odds of the
fraction left over), and the sample is the front of that ranking that holds the missing words. The size of the sample is fixed
in words: the front ends before the first document that does not fit, the gap is filled the same way from the documents
behind it that still fit, and the last document that did not fit is added if that comes nearer to the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbook.llm.common import prepare
from reelbook.llm.ranks import ranked
from reelbook.session import stage

#: Shares of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Copies of a document at most.
COPIES = 3
#: Ranked documents of a slice whose sizes one task adds up.
SLICE = 4096
#: Times the front of the ranking is continued with smaller documents.
FILLS = 3
#: Document weights are whole multiples of one part in so many, so that their sums are exact in any order.
UNIT = 1 << 20
_WORD, _BLANK = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r"^[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other characters than the six of ASCII white space; null has none."""
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, ""), _WORD, "x")
    return F.length(marks).cast("bigint")


def random_odds(key: Column, seed: str) -> tuple[Column, Column]:
    """Odds of a number in (0, 1) that the key and the seed fix, and the text both come from."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return u / (F.lit(1.0) - u), digest


def _exact(x: Column | str) -> Column:
    return F.col(x).cast("decimal(19,0)") if isinstance(x, str) else x.cast("decimal(19,0)")


def source_targets(sizes: DataFrame, weights: Sequence[int], copies: int) -> DataFrame:
    """Words each source is to give: _source, source_size, target. Stored.

    Sources share the sum of all sizes by weight; a target stops at ``copies`` times its source's size and the excess is shared again
    by weight until none is above. Each round is one sum over the sources, and rounds are about as many as the sizes have digits.
    """
    totals = sizes.groupBy("_source").agg(F.sum("size").cast("bigint").alias("source_size"))
    placed = ranked(totals, [F.col("_source").isNull().asc(), F.col("_source").asc()], "mix-sources")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    table = stage(placed.withColumn("_weight", F.try_element_at(turn, (F.pmod("_pos", F.lit(len(weights))) + 1).cast("int")).cast("bigint")), "mix-sources")
    total, share = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("_weight")).first())
    left, stopped = total, 0
    most = F.col("source_size") * copies
    while share > 0:
        # The share of a source against what it may give, as whole numbers.
        full = _exact(most) * _exact(F.lit(share)) <= _exact("_weight") * _exact(F.lit(left))
        n, given, rest = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_weight")))).first()
        if n == stopped:
            break
        left, share, stopped = total - int(given or 0), int(rest or 0), n
    if share > 0:
        even = (_exact("_weight") * _exact(F.lit(left))).cast("double") / F.lit(float(share))
        target = F.when(_exact(most) * _exact(F.lit(share)) <= _exact("_weight") * _exact(F.lit(left)), most.cast("double")).otherwise(even)
    else:
        target = most.cast("double")
    return stage(table.select("_source", "source_size", target.alias("target")), "mix-targets")


def _expected(rows: DataFrame, copies: int) -> DataFrame:
    """``rows`` with ``_copies``, the expected number of copies of a document, in proportion to its weight up to ``copies``.

    The factor of a source solves: sizes times copies sum to the target. A factor that lets more documents stop at ``copies`` is
    raised for the others; a round is one sum over all rows.
    """
    opened = rows.groupBy("_source").agg(F.first("target").alias("_t"), F.sum(_exact("size") * _exact("_weight")).cast("double").alias("_open"))
    factor = F.when(F.col("_open") > 0, F.col("_t") / F.col("_open"))
    state = stage(opened.select("_source", factor.alias("_factor"), F.lit(0).cast("bigint").alias("_stopped")), "mix-factors")
    moving = True
    while moving:
        known = state.select(F.col("_source").alias("_of"), "_factor", "_stopped")
        joined = rows.join(known, F.col("_source").eqNullSafe(F.col("_of")), "left")
        full = F.coalesce(F.col("_factor") * F.col("_weight") >= copies, F.lit(False))
        sums = joined.groupBy("_source").agg(
            F.first("target").alias("_t"), F.count(F.when(full, 1)).alias("_n"), F.first("_stopped").alias("_stopped"), F.first("_factor").alias("_old"),
            F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("_given"),
            F.coalesce(F.sum(F.when(~full, _exact("size") * _exact("_weight"))), F.lit(0)).cast("double").alias("_open"),
        )
        moved = F.col("_n") > F.col("_stopped")
        raised = F.when(moved & (F.col("_open") > 0), F.greatest("_old", (F.col("_t") - copies * F.col("_given")) / F.col("_open"))).otherwise(F.col("_old"))
        state = stage(sums.select("_source", raised.alias("_factor"), F.col("_n").alias("_stopped"), moved.alias("_moved")), "mix-factors")
        moving = state.where("_moved").limit(1).count() > 0
    factors = state.select(F.col("_source").alias("_of"), "_factor")
    wanted = F.least(F.coalesce(F.col("_factor") * F.col("_weight"), F.lit(0.0)), F.lit(float(copies)))
    return rows.join(factors, F.col("_source").eqNullSafe(F.col("_of")), "left").select(*rows.columns, wanted.alias("_copies"))


def _front(drawn: DataFrame, state: DataFrame) -> DataFrame:
    """One step along the ranking: ``state`` (_source, _rest, _after) moved to the first document that does not fit.

    Adds ``_from``, ``_to``, ``_fits``: documents with _from < place < _to and a size up to _fits are taken.
    Sizes are added up by slice first; only the slice in which a source's words run out is looked at row by row.
    """
    kept = [F.col(c) for c in ("_source", "_rest", "_after")]
    side = state.select(F.col("_source").alias("_of"), F.col("_rest"), F.col("_after"))
    able = drawn.join(side, F.col("_source").eqNullSafe(F.col("_of"))).where((F.col("_pos") > F.col("_after")) & (F.col("size") <= F.col("_rest")))
    slices = able.groupBy("_source", "_slice", "_rest").agg(F.sum("size").alias("_sum"))
    up_to = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_slice"))
    broken = slices.withColumn("_cum", up_to).where(F.col("_cum") > F.col("_rest")).groupBy("_source").agg(
        F.min(F.struct("_slice", (F.col("_cum") - F.col("_sum")).alias("_cum"))).alias("_at"))
    at = broken.select(F.col("_source").alias("_in"), F.col("_at._slice").alias("_slice"), F.col("_at._cum").alias("_before"))
    rows = able.join(at.withColumnRenamed("_slice", "_s"), F.col("_source").eqNullSafe(F.col("_in")) & (F.col("_slice") == F.col("_s")))
    cum = F.col("_before") + F.sum("size").over(Window.partitionBy("_source").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    first = rows.withColumn("_cum", cum).where(F.col("_cum") > F.col("_rest")).groupBy("_source").agg(
        F.min(F.struct("_pos", (F.col("_cum") - F.col("size")).alias("_cum"), "size")).alias("_first"))
    whole = slices.groupBy("_source").agg(F.sum("_sum").alias("_all"))
    moved = state.select(*kept).join(first.select(F.col("_source").alias("_a"), "_first"), F.col("_source").eqNullSafe(F.col("_a")), "left")
    moved = moved.join(whole.select(F.col("_source").alias("_b"), "_all"), F.col("_source").eqNullSafe(F.col("_b")), "left")
    ended = F.col("_first").isNull()
    return stage(moved.select(
        "_source", F.col("_after").alias("_from"), F.when(ended, F.lit(1 << 62)).otherwise(F.col("_first._pos")).alias("_to"), F.col("_rest").alias("_fits"),
        F.when(ended, F.lit(1 << 62)).otherwise(F.col("_first._pos")).alias("_after"),
        (F.col("_rest") - F.when(ended, F.coalesce("_all", F.lit(0))).otherwise(F.col("_first._cum"))).alias("_rest"),
        F.col("_first.size").alias("_next"),
    ), "mix-front")


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
                copies: int = COPIES, weight: str | None = None, seed: str = "mix", fills: int = FILLS) -> DataFrame:
    """How often each document is taken: key, source, size, source_size, target, copies, taken (copies times size).

    ``size`` counts words, none for a null text; a document without words is taken no time. ``weights`` belong to the sources in
    code-point order, null last. ``weight`` names a column that makes documents of a source more or less likely (null and
    negative: not at all); without it all are alike. The draw depends on the seed and the key alone, so reruns agree; a null key
    draws as an empty one, and of rows equal in key and size any may be the one taken. No rows give no rows.
    """
    prepare(docs.sparkSession)
    own = F.lit(UNIT) if weight is None else F.greatest(F.coalesce(F.round(F.col(weight).cast("double") * UNIT), F.lit(0.0)), F.lit(0.0))
    plain = docs.select(
        F.col(key).cast("bigint").alias("_key"), F.col(source).cast("string").alias("_source"), word_count(F.col(text).cast("string")).alias("size"),
        own.cast("bigint").alias("_weight"),
    )
    rows = stage(plain, "mix-rows")
    targets = source_targets(rows, weights, copies)
    side = targets.select(F.col("_source").alias("_of"), "source_size", "target")
    rows = rows.join(side, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    if weight is None:
        rows = rows.withColumn("_copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    else:
        rows = stage(_expected(stage(rows, "mix-weighted"), copies), "mix-expected")
    whole = F.floor("_copies")
    rows = rows.withColumn("_whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("bigint")).withColumn("_chance", F.col("_copies") - whole)
    odds, digest = random_odds(F.col("_key"), seed)
    in_draw = (F.col("_chance") > 0) & (F.col("size") > 0)
    pareto = odds * ((F.lit(1.0) - F.col("_chance")) / F.col("_chance"))
    drawn = rows.where(in_draw).select("_key", "_source", "size", "_whole", digest.alias("_digest"), pareto.alias("_pareto"))
    order = [F.col(c).asc() for c in ("_source", "_pareto", "_digest", "size")]
    drawn = stage(ranked(drawn, order, "mix-order").withColumn("_slice", F.floor(F.col("_pos") / SLICE)).drop("_pareto", "_digest"), "mix-drawn")
    certain = rows.groupBy("_source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("size"))).alias("_rest"), F.lit(-1).cast("bigint").alias("_after"))
    state = stage(certain, "mix-front")
    steps = []
    for _ in range(1 + fills):
        state = _front(drawn, state)
        steps.append(state)
    nearer = state.where(F.col("_next").isNotNull() & (F.col("_rest") * 2 >= F.col("_next")))
    ends = nearer.select("_source", (F.col("_to") - 1).alias("_from"), (F.col("_to") + 1).alias("_to"), F.col("_next").cast("double").alias("_fits"))
    spans = ends
    for step in steps:
        spans = spans.unionByName(step.select("_source", "_from", "_to", F.col("_fits").cast("double").alias("_fits")))
    # At most ``fills`` + 2 spans a source.
    spans = stage(spans.groupBy("_source").agg(F.collect_list(F.struct("_from", "_to", "_fits")).alias("_spans")), "mix-spans")
    hit = F.exists("_spans", lambda s: (F.col("_pos") > s["_from"]) & (F.col("_pos") < s["_to"]) & (F.col("size") <= s["_fits"]))
    once = drawn.join(spans.select(F.col("_source").alias("_of"), "_spans"), F.col("_source").eqNullSafe(F.col("_of"))).select(
        "_key", "_source", "size", (F.col("_whole") + hit.cast("bigint")).alias("copies"))
    never = rows.where(~in_draw).select("_key", "_source", "size", F.col("_whole").alias("copies"))
    return once.unionByName(never).join(side, F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def twin_sql(weights: Sequence[int] = WEIGHTS, copies: int = COPIES, seed: str = "mix", fills: int = FILLS) -> str:
    """The mix of ``documents`` without document weights as one DuckDB statement."""
    turn = f"list_value({', '.join(map(str, weights))})[(r % {len(weights)}) + 1]"
    steps = []
    for i in range(1 + fills):
        steps.append(f"""
    c{i} as (select d.*, s.rest, sum(d.size) over (partition by d.src order by d.pos) as cum from drawn d join s{i} s on s.src = d.src
             where d.pos > s.af and d.size <= s.rest),
    b{i} as (select src, min(pos) as pos, arg_min(size, pos) as size, arg_min(cum - size, pos) as before from c{i} where cum > rest group by src),
    s{i + 1} as (select s.src, s.af as lo, coalesce(b.pos, 4611686018427387904) as af, s.rest as fits,
                 s.rest - cast(case when b.src is null then coalesce((select sum(size) from c{i} c where c.src = s.src), 0) else b.before end as double) as rest,
                 b.size as nxt
                 from s{i} s left join b{i} b on b.src = s.src)""")
    spans = " union all ".join(f"select src, lo, af as hi, fits from s{i + 1}" for i in range(1 + fills))
    last = f"s{1 + fills}"
    return rf"""
    with rows_ as (select doc_id, source, coalesce('=' || source, '') as src,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
    totals as (select src, cast(sum(size) as hugeint) as n, row_number() over (order by src = '', src) - 1 as r from rows_ group by src),
    weighed as (select src, n, cast({turn} as hugeint) as w from totals),
    full_ as (select a.src from weighed a, weighed b group by a.src, a.n, a.w
              having sum(case when b.n * a.w <= a.n * b.w then {copies} * b.n * a.w else {copies} * a.n * b.w end) <= (select sum(n) from weighed) * a.w),
    open_ as (select (select sum(n) from weighed) - coalesce((select sum({copies} * n) from weighed where src in (from full_)), 0) as num,
                     (select sum(w) from weighed where src not in (from full_)) as den),
    targets as (select src, cast(n as bigint) as source_size,
                case when src in (from full_) then cast({copies} * n as double) else cast(w * num as double) / cast(den as double) end as target
                from weighed, open_),
    e as (select r.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as copies,
                 md5('{seed}:' || coalesce(cast(doc_id as varchar), '')) as digest
          from rows_ r join targets t on t.src = r.src),
    f as (select *, case when size > 0 then cast(floor(copies) as bigint) else 0 end as whole, copies - floor(copies) as chance,
                 (cast(cast('0x' || substr(digest, 1, 13) as bigint) as double) + cast(0.5 as double)) / cast({1 << 52} as double) as u from e),
    drawn as (select *, row_number() over (partition by src order by (u / (cast(1 as double) - u)) * ((cast(1 as double) - chance) / chance), digest, size) as pos
              from f where chance > 0 and size > 0),
    s0 as (select src, any_value(target) - cast(sum(whole * size) as double) as rest, -1 as af from f group by src),{','.join(steps)},
    spans as ({spans} union all select src, af - 1, af + 1, cast(nxt as double) from {last} where nxt is not null and rest * 2 >= nxt),
    once as (select distinct d.src, d.pos from drawn d join spans p on p.src = d.src and d.pos > p.lo and d.pos < p.hi and d.size <= p.fits),
    every as (select d.doc_id, d.source, d.size, d.source_size, d.target, d.whole + case when o.pos is null then 0 else 1 end as copies
              from drawn d left join once o on o.src = d.src and o.pos = d.pos
              union all select doc_id, source, size, source_size, target, whole from f where not (chance > 0 and size > 0))
    select doc_id, source, cast(size as bigint) as size, source_size, target, cast(copies as bigint) as copies, cast(copies * size as bigint) as taken from every"""
