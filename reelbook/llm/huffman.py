"""Token ids in files, by a canonical length-limited Huffman code.

One code serves all files: it comes from the counts of all ids. A file holds documents in key order; its ids are cut into
blocks of a fixed number, and the bit offset of each block is kept, so any block can be decoded by itself. Decoding looks up
the next ``MOST_BITS`` bits in a table and advances by the length found there, for many blocks in step.

Layout of a file, little-endian (fixed values): magic ``HUFIDS01``, then six 8-byte integers (code entries, ids, ids per block,
blocks, documents, bytes of code bits); per code entry a 4-byte id and a 1-byte length; per block its 8-byte bit offset; per
document an 8-byte key, a flag byte (1: no key) and an 8-byte number of ids; then the code bits, first bit highest.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, open_input, open_output, prepare, shared_files, unique_file
from reelbook.llm.packing import token_rows
from reelbook.llm.tokens import ID
from reelbook.session import stage

MAGIC = b"HUFIDS01"
#: Longest code word; the decoding table has two to this power entries.
MOST_BITS = 18
#: Ids of a block.
BLOCK_IDS = 1024
#: Ids a file holds, about; a file never parts a document.
FILE_IDS = 4_000_000
#: Ids encoded or decoded at once.
CHUNK_IDS = 1 << 20


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Length of the code word of each id that occurs: the best code with no word above ``most`` bits.

    Coin collector's method: in each of ``most`` rounds items are paired, cheapest first, and the pairs join the items of the
    next round; an id's length is the number of times it is among the cheapest ``2 n - 2`` of the last round.
    """
    items = sorted((c, i) for i, c in counts.items() if c > 0)
    if len(items) <= 1:
        return {i: 1 for _, i in items}
    if len(items) > 1 << most:
        raise ValueError("more ids than code words")
    n = len(items)
    weights = [c for c, _ in items]
    # Only the weights of packages and, per round, which places hold single items are kept.
    rounds: list[list[bool]] = []
    packages: list[int] = []
    for _ in range(most):
        merged = list(heapq.merge(((w, True) for w in weights), ((w, False) for w in packages), key=lambda x: x[0]))
        rounds.append([single for _, single in merged])
        packages = [merged[k][0] + merged[k + 1][0] for k in range(0, len(merged) - 1, 2)]
    lengths = [0] * n
    taken = 2 * n - 2
    for singles in reversed(rounds):
        used = sum(singles[:taken])
        for k in range(used):
            lengths[k] += 1
        taken = 2 * (taken - used)
    return {i: length for (_, i), length in zip(items, lengths)}


class Code:
    """Canonical code words of given lengths, with tables to encode and decode."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.bits = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.table_id, self.table_length = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
        word, before, at = 0, 0, 0
        for i in order:
            n = lengths[i]
            word <<= n - before
            before = n
            self.word[i], self.length[i] = word, n
            span = 1 << (self.bits - n)
            self.table_id[at : at + span], self.table_length[at : at + span] = i, n
            at += span
            word += 1

    def encode(self, ids: np.ndarray, first_bit: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Code bits of ids as 32-bit words, of which the first starts at ``first_bit`` (below 32); bit offset of each id; end."""
        sizes = self.length[ids]
        ends = np.cumsum(sizes) + first_bit
        starts = ends - sizes
        end = int(ends[-1]) if len(ids) else first_bit
        words = np.zeros(end // 32 + 2, np.uint64)
        # A code word touches two 32-bit words at most; no two overlap, so sums are unions, exact in doubles.
        place = starts >> 5
        both = self.word[ids] << (64 - sizes - (starts & 31)).astype(np.uint64)
        for shift, part in ((0, both >> np.uint64(32)), (1, both & np.uint64(0xFFFFFFFF))):
            summed = np.bincount(place + shift, part.astype(np.float64), len(words))
            words += summed.astype(np.uint64)
        return words.astype(np.uint32), starts, end

    def decode(self, bits: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks that start at ``offsets`` and hold ``sizes`` ids, one row per block; ``bits`` as big-endian 32-bit words."""
        rows = np.zeros((int(sizes.max(initial=0)), len(offsets)), np.uint32)
        at = offsets.astype(np.int64)
        low, keep = np.uint64(64 - self.bits), len(sizes)
        for step in range(len(rows)):
            alive = sizes[:keep] > step
            if not alive.all():  # only the last block may be short
                keep = int(np.count_nonzero(alive))
                at = at[:keep]
            place = at >> 5
            window = (bits[place] << np.uint64(32)) | bits[place + 1]
            look = ((window << (at & 31).astype(np.uint64)) >> low).astype(np.int64)
            rows[step, :keep] = self.table_id[look]
            at += self.table_length[look]
        return rows


def id_counts(tokens: DataFrame) -> DataFrame:
    """Number of times each id occurs in all rows: id, n. Counted per task, then summed."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in batch.column(0):
                seen += np.bincount(np.frombuffer(data.as_buffer(), ID), minlength=len(seen)) if len(data.as_buffer()) else 0
        found = np.flatnonzero(seen)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], schema=out)

    return tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_file(uri: str, code: Code, docs: list[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write documents (key, ids) to one file: number of ids, bytes."""
    ids = np.frombuffer(b"".join(d for _, d in docs), ID)
    parts, offsets, bit, carry = [], [], 0, np.uint32(0)
    for at in range(0, len(ids), CHUNK_IDS):
        words, starts, end = code.encode(ids[at : at + CHUNK_IDS], bit % 32)
        words[0] |= carry
        offsets.append(starts[::BLOCK_IDS] + (bit - bit % 32))
        full = end // 32
        parts.append(words[:full].astype(">u4").tobytes())
        carry, bit = words[full], bit - bit % 32 + end
    payload = b"".join(parts) + np.array([carry, 0], ">u4").tobytes()
    starts = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    entries = sorted(code.lengths.items())
    table = np.array([(i, n) for i, n in entries], np.dtype([("id", "<u4"), ("length", "u1")]))
    listed = np.array([(k or 0, k is None, len(d) // 2) for k, d in docs], np.dtype([("key", "<i8"), ("none", "u1"), ("ids", "<i8")]))
    head = np.array([len(entries), len(ids), BLOCK_IDS, len(starts), len(docs), len(payload)], "<i8")
    with open_output(uri) as out:
        for part in (MAGIC, head.tobytes(), table.tobytes(), starts.astype("<i8").tobytes(), listed.tobytes(), payload):
            out.write(part)
    return len(ids), len(MAGIC) + head.nbytes + table.nbytes + 8 * len(starts) + listed.nbytes + len(payload)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents (key, ids) of a file in their order. The code is the one kept in the file."""
    with open_input(uri) as file:
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no file of coded ids")
        entries, n_ids, per_block, blocks, documents, payload = np.frombuffer(file.read(48), "<i8").tolist()
        table = np.frombuffer(file.read(5 * entries), np.dtype([("id", "<u4"), ("length", "u1")]))
        code = Code(dict(zip(table["id"].tolist(), table["length"].tolist())))
        offsets = np.frombuffer(file.read(8 * blocks), "<i8")
        listed = np.frombuffer(file.read(17 * documents), np.dtype([("key", "<i8"), ("none", "u1"), ("ids", "<i8")]))
        bits = np.frombuffer(file.read(payload), ">u4").astype(np.uint64)
    sizes = np.minimum(per_block, n_ids - per_block * np.arange(blocks))
    ids = np.ascontiguousarray(code.decode(bits, offsets, sizes).T).ravel()[:n_ids].astype(ID)
    ends = np.cumsum(listed["ids"])
    for key, none, end, n in zip(listed["key"].tolist(), listed["none"].tolist(), ends.tolist(), listed["ids"].tolist()):
        yield None if none else key, ids[end - n : end]


def write_coded(tokens: DataFrame, folder: str, *, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents in ascending key order (no key first) to files in ``folder``: part, path, n_ids, n_bytes per file.

    ``tokens`` is stored (_key, ids, n_tokens). Rows are sorted across partitions by key (equal keys by a hash of their ids); a partition is cut into files
    of about ``file_ids`` ids. Each attempt of a task names its own files, and only those of finished tasks are in the result.
    """
    spark = tokens.sparkSession
    counts = dict(id_counts(tokens).toPandas().itertuples(index=False))  # an entry per id of the vocabulary
    code = spark.sparkContext.broadcast(code_lengths({int(i): int(n) for i, n in counts.items()}))
    total = sum(counts.values())
    parts = max(1, -(-int(total) // file_ids))
    out = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches):
        def files():
            made, kept, held, place = None, [], 0, 0
            part = TaskContext.get().partitionId()

            def flush():
                path = unique_file(folder, f"ids-{part:06d}", ".huf")
                return part, place, path, *write_file(path, made, kept)

            for batch in batches:
                made = made or Code(code.value)
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    kept.append((key, data))
                    held += len(data) // 2
                    if held >= file_ids:
                        yield flush()
                        kept, held, place = [], 0, place + 1
            if kept:
                yield flush()

        yield from batches_of(out, files(), size=1)

    first = F.col("_key").asc_nulls_first()
    # Ranges are found from a sample that the driver gets: a hash in place of the ids keeps it small.
    marked = tokens.select("_key", "ids").withColumn("_mark", F.xxhash64("ids"))
    ranged = marked.repartitionByRange(parts, first, "_mark").sortWithinPartitions(first, "_mark", "ids").select("_key", "ids")
    return stage(ranged.mapInArrow(write, "part bigint, place bigint, path string, n_ids bigint, n_bytes bigint"), "files")


def read_coded(files: DataFrame) -> DataFrame:
    """Documents read back from files that :func:`write_coded` lists: _key, start, n_tokens, ids_crc32.

    ``start`` is the number of ids of all documents before, in file order.
    """
    order = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    shifted = files.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    out = pa.schema([("_key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        def rows():
            for batch in batches:
                for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for key, ids in read_file(path):
                        yield key, start, len(ids), zlib.crc32(ids.astype("<u4"))
                        start += len(ids)

        yield from batches_of(out, rows())

    tasks = max(1, files.count())
    dealt = shifted.repartition(tasks, "path")
    return dealt.mapInArrow(read, "_key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def coded_round_trip(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Whole texts encoded, written to coded files in the shared folder and read back: key, start, n_tokens, ids_crc32."""
    spark: SparkSession = prepare(docs.sparkSession)
    tokens = stage(token_rows(docs, key=key, text=text, source=None, path=path), "tokens")
    files = write_coded(tokens, shared_files(spark, "coded"))
    return read_coded(files).withColumnRenamed("_key", key)
