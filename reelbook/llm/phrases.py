"""Phrases of a language: exact counts of word runs by direct-address tiles, scored by the weakest cut.

Texts are cut into blocks of tokens kept as files in the shared folder. A block names its units (at first words) by places in a list of its
own; only these lists meet across blocks. Units frequent over all blocks get numbers in order of frequency. A block then reads its
tokens by those numbers and counts neighbouring pairs tile by tile: pairs of frequent numbers lie close together, so a tile that
holds many is an array addressed by the pair itself (bincount), and what lies in sparse tiles is sorted and run-length counted.
The counts of all blocks are added the same way, a band of first units at a time. Frequent pairs are the units of the next round: two units of length k that overlap in all but one word are a phrase of k + 1.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelbook.llm.common import file_system, open_input, open_output, prepare, shared_files
from reelbook.llm.ranks import ranked
from reelbook.session import stage

#: Tokens of a block; a longer text is a block of its own.
BLOCK_TOKENS = 2_000_000
#: Side of a tile, and the least share of its cells that makes it an array.
SIDE, DENSE = 1024, 1 / 8
#: Tokens whose pairs are counted over all blocks in one task.
BAND = 2_000_000
#: Rows of an Arrow batch of counts.
BATCH_ROWS = 100_000
LEAST_COUNT, LONGEST, PER_LANGUAGE = 30, 4, 2000
SCALE, ABSORBED = 2_000_000, (80, 100)
_BREAK, _BLANK, _LETTER = 2, 1, 0
_WORDS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered; what a byte is: blank (space, tab), break (. , ; : ! ? and 10 to 13) or part of a word. Fixed values."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.full(256, _LETTER, np.uint8)
    kind[[0x20, 0x09]] = _BLANK
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
    return lower, kind


_LOWER, _KIND = _byte_tables()


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts end to end, their lengths in bytes, and which of them begin a piece."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0 or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[data]
    inside = kind == _LETTER
    edges = np.unique(offsets[:-1] - offsets[0])
    edges = edges[edges < len(data)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    # Letters after a start belong to it until the next start, so lengths are counts of letters between starts.
    letters = np.concatenate([[0], np.cumsum(inside)])
    lengths = np.diff(np.append(letters[starts], letters[-1]))
    parted = kind == _BREAK
    parted[edges] |= True  # a text ends a piece; a first letter that is no break itself comes behind this mark
    marks = np.cumsum(parted)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = marks[1:] != marks[:-1]
    return _LOWER[data[inside]], lengths, first


_WRITTEN = itertools.count()


def _file(folder: str, block: int) -> str:
    return f"{folder}/block-{block}.zst"


def _write(folder: str, stream: np.ndarray, block: int | None = None) -> int:
    """Stores a stream under ``block``, or under a number that no other attempt of a task gives; the file gets its name when it is whole."""
    own = TaskContext.get().taskAttemptId() << 24 | next(_WRITTEN) % (1 << 24)
    block = own if block is None else block
    part = f"{folder}/part-{own}"
    with pa.CompressedOutputStream(open_output(part), "zstd") as out:
        out.write(np.ascontiguousarray(stream, "<i4"))
    fs, path = file_system(part)
    whole = file_system(_file(folder, block))[1]
    if fs.get_file_info(whole).type == pa.fs.FileType.NotFound:
        fs.move(path, whole)
    else:  # another attempt was first, with the same tokens
        fs.delete_file(path)
    return block


def _read(folder: str, block: int) -> np.ndarray:
    with open_input(_file(folder, block)) as file, pa.CompressedInputStream(file, "zstd") as stream:
        return np.frombuffer(stream.read(), "<i4")


def _listed(schema: pa.Schema, block: int, columns: list) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    table = pa.table([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), *columns], schema=schema)
    yield from table.to_batches(max_chunksize=BATCH_ROWS)


class _Block:
    """Tokens of texts by language until there are enough for a file."""

    def __init__(self, folder: str):
        self._folder, self._held, self.tokens = folder, {}, 0

    def add(self, lang: str, texts: pa.Array) -> None:
        words = tokens_of(texts)
        if len(words[1]):
            self._held.setdefault(lang, []).append(words)
            self.tokens += len(words[1])

    def close(self) -> Iterator[pa.RecordBatch]:
        """Writes the places of the words, -1 between pieces; yields the list of words."""
        streams, langs, words, counts, base = [], [], [], [], 0
        for lang in sorted(self._held):
            data, lengths, first = (np.concatenate(x) for x in zip(*self._held[lang]))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(data)])
            coded = column.dictionary_encode()
            place = coded.indices.to_numpy().astype(np.int32) + base
            streams += [np.insert(place, np.flatnonzero(first), -1)]
            words.append(coded.dictionary.cast(pa.large_string()).cast(pa.string()))
            langs.append(pa.repeat(lang, len(coded.dictionary)))
            counts.append(np.bincount(place - base, minlength=len(coded.dictionary)))
            base += len(coded.dictionary)
        if streams:
            block = _write(self._folder, np.concatenate(streams))
            yield from _listed(_WORDS, block, [pa.concat_arrays(langs), pa.concat_arrays(words), pa.array(np.concatenate(counts))])
        self._held, self.tokens = {}, 0


def word_lists(docs: DataFrame, folder: str) -> DataFrame:
    """Cuts texts (text, lang; no nulls) into blocks in ``folder``; the words of each block: block, place, lang, word, n."""

    def run(batches):
        block = _Block(folder)
        for batch in batches:
            text, lang = batch.column(0), batch.column(1)
            for name in pc.unique(lang).to_pylist():
                block.add(name, text.filter(pc.equal(lang, name)))
            if block.tokens >= BLOCK_TOKENS:
                yield from block.close()
        yield from block.close()

    return docs.select("text", "lang").mapInArrow(run, "block bigint, place int, lang string, word string, n bigint")


def tile_counts(u: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (u, v) with the sums of ``n`` (by default their counts), and which of them each given pair is.

    Numbers are first replaced by their rank among those given, which keeps their order of frequency. A tile holds the pairs of two
    runs of ``SIDE`` ranks.
    """
    names, coded = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = coded[: len(u)], coded[len(u) :]
    across = -(-len(names) // SIDE)
    tile = (a // SIDE) * across + b // SIDE
    which = np.empty(len(u), np.int64)
    in_tile = np.bincount(tile) if len(tile) else np.zeros(0, np.int64)
    pairs, known = [], 0
    rest = np.ones(len(u), bool)
    for t in np.flatnonzero(in_tile >= SIDE * SIDE * DENSE).tolist():
        at = np.flatnonzero(tile == t)
        rest[at] = False
        cell = (a[at] % SIDE) * SIDE + b[at] % SIDE
        hit = np.bincount(cell, minlength=SIDE * SIDE) > 0
        used = np.flatnonzero(hit)
        which[at] = known + (np.cumsum(hit) - 1)[cell]
        pairs.append(((t // across) * SIDE + used // SIDE) * len(names) + (t % across) * SIDE + used % SIDE)
        known += len(used)
    at = np.flatnonzero(rest)
    code, back = np.unique(a[at] * np.int64(len(names)) + b[at], return_inverse=True)
    which[at] = known + back
    code = np.concatenate([*pairs, code]).astype(np.int64)
    sums = np.bincount(which, n, minlength=len(code)).astype(np.int64)  # exact below 2 ** 53
    return names[code // max(1, len(names))], names[code % max(1, len(names))], sums, which


# Runs of whole numbers as bytes -----------------------------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    """Columns of natural numbers of one length, each in as many bytes as its greatest needs, bytes of equal weight together."""
    parts, widths = [], []
    for column in columns:
        width = next(w for w in (1, 2, 4, 8) if int(column.max(initial=0)) < 1 << (8 * w))
        widths.append(width)
        parts.append(np.ascontiguousarray(column.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes())
    return bytes(widths) + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, columns: int) -> list[np.ndarray]:
    """What :func:`packed` was given."""
    widths, out, at = data[:columns], [], 0
    raw = np.frombuffer(pa.decompress(data[columns:], rows * sum(widths), codec="zstd", asbytes=True), np.uint8)
    for width in widths:
        out.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).view(f"<u{width}").ravel().astype(np.int64))
        at += rows * width
    return out


def packed_pairs(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of (u, v) with counts; v is kept as the step from the pair before where u stays the same."""
    step_u = np.diff(u, prepend=0)
    same = step_u == 0
    same[:1] = False
    return packed(step_u, np.where(same, np.diff(v, prepend=0), v), n)


def unpacked_pairs(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`packed_pairs` was given."""
    step_u, step_v, n = unpacked(data, rows, 3)
    u = np.cumsum(step_u)
    first = np.ones(rows, bool)
    first[1:] = u[1:] != u[:-1]
    run, total = np.cumsum(first) - 1, np.cumsum(step_v)
    return u, total - (total - step_v)[first][run], n


# Rounds -----------------------------------------------------------------------------------------------------------------


class Bands:
    """Runs of unit numbers whose units begin about ``BAND`` tokens together; one with more is dealt to parts by the second unit."""

    def __init__(self, first: list[int], parts: list[int]):
        self.first, self.parts = np.array(first, np.int64), np.array(parts, np.int64)

    def of(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        band = np.searchsorted(self.first, u, "right") - 1
        return band, v % self.parts[band]


def bands_of(units: DataFrame) -> Bands:
    """Bands of numbered units (id, f). The driver gets two numbers per band, one band per ``BAND`` tokens at most."""
    slices = units.groupBy(F.floor(F.col("id") / 4096).alias("_slice")).agg(F.sum("f").alias("_n"))
    earlier = slices.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("f").over(Window.partitionBy("_slice").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = units.withColumn("_slice", F.floor(F.col("id") / 4096)).withColumn("_inside", inside).join(earlier.select("_slice", "_before"), "_slice")
    band = F.floor((F.col("_before") + F.col("_inside")) / BAND)
    found = placed.groupBy(band.alias("band")).agg(F.min("id").alias("first"), F.ceil(F.sum("f") / BAND).alias("parts")).orderBy("first").collect()
    return Bands([r["first"] for r in found], [r["parts"] for r in found])


_LISTED = pa.schema([("band", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("base", pa.int64()), ("rows", pa.int64()), ("data", pa.binary())])
_FOUND = pa.schema([*_LISTED, ("idx", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("kind", pa.string())])
_NAMED = pa.schema([("block", pa.int64()), ("rows", pa.int64()), ("data", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    spelled = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {spelled[f.type]}" for f in schema)


def _numbers(named: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places in a block and the numbers of the units there, from plain or packed rows."""
    if "data" not in named.column_names:
        return named["place"].to_numpy(), named["id"].to_numpy()
    parts = [unpacked(d, r, 2) for d, r in zip(named["data"].to_pylist(), named["rows"].to_pylist())]
    return np.concatenate([np.cumsum(p) for p, _ in parts]), np.concatenate([i for _, i in parts])


def pair_lists(named: DataFrame, folder: str, onward: str | None, bands: Bands) -> DataFrame:
    """Pairs of neighbouring units in each block, a row per block, band and part: places from ``base`` on, packed.

    ``named`` has the numbers of the frequent units of the blocks in ``folder``. The blocks by their pairs are written to ``onward``, if
    given, under the same numbers: what a block becomes depends on its rows alone, and its file appears whole or not at all.
    """

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        places, ids = _numbers(table)
        stream = _read(folder, block)
        number = np.full(max(stream.max(), places.max()) + 2, -1, np.int64)
        number[places] = ids
        ids = number[stream]  # a break, -1, reads the last entry, which names nothing
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(at):
            return _LISTED.empty_table()
        u, v, n, which = tile_counts(ids[at], ids[at + 1])
        band, part = bands.of(u, v)
        order = np.lexsort((v, u, part, band))
        u, v, n, band, part = (x[order] for x in (u, v, n, band, part))
        if onward is not None:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # Pairs that begin at neighbouring tokens stay neighbours.
            _write(onward, np.insert(place[which], np.flatnonzero(np.diff(at, prepend=-2) > 1), -1), block)
        starts = np.flatnonzero((np.diff(band, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        ends = np.append(starts[1:], len(u))
        data = [packed_pairs(u[i:j], v[i:j], n[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]
        return pa.table([pa.array(band[starts]), pa.array(part[starts]), pa.array(np.full(len(starts), block)), pa.array(starts), pa.array(ends - starts), pa.array(data, pa.binary())], schema=_LISTED)

    return named.groupBy("block").applyInArrow(run, _ddl(_LISTED))


def frequent_pairs(lists: DataFrame, least: int) -> DataFrame:
    """Counts every band over all blocks: rows of kind ``unit`` are its pairs of at least ``least`` occurrences, rows of kind ``hits`` tell where the blocks have them."""

    def run(table: pa.Table) -> pa.Table:
        rows = table["rows"].to_pylist()
        parts = [unpacked_pairs(d, r) for d, r in zip(table["data"].to_pylist(), rows)]
        u, v, n, which = tile_counts(*(np.concatenate(x) for x in zip(*parts)))
        kept = np.flatnonzero(n >= least)
        if not len(kept):
            return _FOUND.empty_table()
        idx = np.full(len(n), -1, np.int64)
        idx[kept] = np.arange(len(kept))
        band, part = table["band"][0], table["part"][0]
        blocks, counts, data, at = [], [], [], 0
        for block, base, r in zip(table["block"].to_pylist(), table["base"].to_pylist(), rows):
            mine = idx[which[at : at + r]]
            at += r
            places = np.flatnonzero(mine >= 0)
            if len(places):
                blocks.append(block)
                counts.append(len(places))
                data.append(packed(np.diff(places + base, prepend=0), mine[places]))

        def of(k: int, kind: str, **columns) -> pa.Table:
            columns |= {"band": pa.repeat(band, k), "part": pa.repeat(part, k), "kind": pa.repeat(kind, k)}
            return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in _FOUND], schema=_FOUND)

        return pa.concat_tables([of(len(kept), "unit", idx=idx[kept], u=u[kept], v=v[kept], n=n[kept]), of(len(blocks), "hits", block=blocks, rows=counts, data=data)])

    return lists.groupBy("band", "part").applyInArrow(run, _ddl(_FOUND))


def named_pairs(found: DataFrame, units: DataFrame) -> DataFrame:
    """Places of the frequent pairs of each block with the numbers the pairs have been given, packed."""

    def run(hits: pa.Table, named: pa.Table) -> pa.Table:
        number = np.empty(named.num_rows, np.int64)
        number[named["idx"].to_numpy()] = named["id"].to_numpy()
        data = []
        for d, r in zip(hits["data"].to_pylist(), hits["rows"].to_pylist()):
            places, idx = unpacked(d, r, 2)
            data.append(packed(places, number[idx]))
        return pa.table([hits["block"], hits["rows"], pa.array(data, pa.binary())], schema=_NAMED)

    hits = found.where("kind = 'hits'").select("band", "part", "block", "rows", "data")
    keys = ["band", "part"]
    return hits.groupBy(*keys).cogroup(units.select(*keys, "idx", "id").groupBy(*keys)).applyInArrow(run, _ddl(_NAMED))


def _numbered(units: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Units (keys, f, ...) numbered from 0 by falling frequency in ``id``. Stored."""
    return stage(ranked(units, [F.desc("f"), *map(F.asc, keys)], label, alias="id"), label)


def _scored(units: DataFrame, length: int) -> DataFrame:
    """Phrases of ``length`` words with their lowest-scoring cut: id, lang, phrase, a, l, r, score."""
    cuts = [F.struct(F.lit(k).alias("k"), F.col("pre")[k - 1].alias("l"), F.col("suf")[length - 1 - k].alias("r")) for k in range(1, length)]
    cut = units.select("id", "lang", "phrase", F.col("f").alias("a"), F.explode(F.array(*cuts)).alias("cut")).select("id", "lang", "phrase", "a", "cut.*")
    score = F.expr(f"(cast(a as decimal(19,0)) * cast({SCALE} as decimal(7,0))) div cast(l + r as decimal(19,0))")
    rows = cut.withColumn("score", score.cast("bigint"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return rows.groupBy("id", "lang", "phrase", "a").agg(weakest).select("id", "lang", "phrase", "a", "w.l", "w.r", "w.score")


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST,
            most: int | None = PER_LANGUAGE, absorbed: tuple[int, int] = ABSORBED) -> DataFrame:
    """Best phrases of 2 to ``longest`` words in each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of ``a`` occurrences scores by its weakest cut into two parts of ``l`` and ``r`` occurrences; one of which a phrase a word longer has
    the share ``absorbed`` of its occurrences is dropped (a still longer one implies that). ``n`` counts the words of the language. A null
    language is ``und``, a null text empty; repeated rows count each time; ties go to the lesser phrase. ``most`` None gives all.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    folder = shared_files(spark, "phrase-blocks")
    lists = stage(word_lists(plain, folder), "words")
    sizes = lists.groupBy("lang").agg(F.sum("n").cast("bigint").alias("n"))
    words = lists.groupBy("lang", "word").agg(F.sum("n").cast("bigint").alias("f")).where(F.col("f") >= least)
    units = _numbered(words, ["lang", "word"], "words")
    named = lists.join(units, ["lang", "word"]).select("block", "place", "id")
    none = F.array().cast("array<bigint>")
    units = units.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("pre"), none.alias("suf"))
    found = []
    for length in range(2, longest + 1):
        onward = shared_files(spark, "phrase-blocks") if length < longest else None
        counted = stage(frequent_pairs(pair_lists(named, folder, onward, bands_of(units)), least), "pairs", partition_by="kind")
        pairs = _numbered(counted.where("kind = 'unit'").select("band", "part", "idx", "u", "v", F.col("n").alias("f")), ["u", "v"], "pairs")
        named, folder = named_pairs(counted, pairs), onward
        front = units.select(F.col("id").alias("u"), "lang", F.col("phrase").alias("_front"), F.array_append("pre", F.col("f")).alias("pre"))
        back = units.select(F.col("id").alias("v"), "last", F.array_append("suf", F.col("f")).alias("suf"))
        phrase = F.concat("_front", F.lit(" "), "last").alias("phrase")
        longer = stage(pairs.join(front, "u").join(back, "v").select("id", "u", "v", "lang", phrase, "last", "f", "pre", "suf"), "units")
        if found:
            inside = longer.select(F.explode(F.array("u", "v")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("_by"))
            held = F.lit(absorbed[1]) * F.coalesce("_by", F.lit(0)) >= F.lit(absorbed[0]) * F.col("a")
            found[-1] = found[-1].join(inside, "id", "left").where(~held).drop("_by")
        found.append(_scored(longer, length))
        units = longer.drop("u", "v")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = every.withColumn("rank", F.row_number().over(order).cast("bigint"))
    if most is not None:
        top = top.where(F.col("rank") <= most)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def twin_sql(least: int = LEAST_COUNT, longest: int = LONGEST, most: int = PER_LANGUAGE, absorbed: tuple[int, int] = ABSORBED) -> str:
    """Phrases of ``documents`` as one DuckDB statement."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                        translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
    starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from words),
    f as (select lang, size, array_to_string(ws[i : i + size - 1], ' ') as phrase, count(*)::hugeint as f
          from starts, (select unnest(range(1, {longest + 1})) as size) where i + size - 1 <= len(ws) group by 1, 2, 3 having count(*) >= {least}),
    sizes as (select lang, sum(len(ws))::bigint as n from words group by lang),
    cuts as (select c.lang, c.size, c.phrase, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') as front,
                    array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') as back
             from f c, (select unnest(range(1, {longest})) as k) where c.size >= 2 and k < c.size),
    scored as (select c.*, l.f as l, r.f as r, ({SCALE} * a) // (l.f + r.f) as score from cuts c
               join f l on l.lang = c.lang and l.phrase = c.front and l.size = k join f r on r.lang = c.lang and r.phrase = c.back and r.size = c.size - k),
    weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    held as (select lang, array_to_string(string_split(phrase, ' ')[x : x + y - 1], ' ') as phrase, max(f) as f
             from f, (select unnest(range(2, {longest})) as y), (select unnest(range(1, {longest})) as x) where y < size and x + y - 1 <= size group by 1, 2)
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from (
        select w.*, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank
        from weakest w left join held h on h.lang = w.lang and h.phrase = w.phrase where h.f is null or {absorbed[1]} * h.f < {absorbed[0]} * a)
    join sizes using (lang) where rank <= {most}"""
