"""Mixture-controlled packing of token documents into sequences of one length.

Each source is a queue of tokens. A window, by default one sequence, takes from every queue in turn what the target mixture
allots to it; the part a queue is left short of is its deficit, carried to the next window. The target is a parameter and by
default the sources' own shares. A queue that has ended leaves its share to the others, so all documents are packed. What a
queue has given before a window follows from the totals and the target alone: with weight ``w`` it is ``w`` times a common
clock, up to its total, the deficit being what rounding cuts off. So a task may begin at any document. Windows are laid end
to end and cut into sequences; only the last is not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, prepare, running_total, texts_of
from reelbook.llm.tokens import END_ID, ID, library_encoder
from reelbook.session import stage

#: Tokens of a sequence.
SEQUENCE = 4096
#: Sequences of a window, over which the mixture holds.
WINDOW_SEQUENCES = 1
#: Queues at most. Sources of the target and the largest others have queues of their own; should more be left than there is
#: room for, the rest shares ``SHARED_QUEUES`` by a hash of the names.
QUEUES, SHARED_QUEUES = 4096, 1024
#: A queue due fewer tokens a window gives them in pieces of this many.
LEAST_PIECE = 64
#: Windows times queues looked at in one step.
CELLS = 1 << 20


def token_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str | None = "source", end: int | None = END_ID,
               path: str | None = None) -> DataFrame:
    """Ids of every whole text with the end id behind: _key, _source, ids (two bytes each), n_tokens. A null text is empty."""
    prepare(docs.sparkSession)
    out = pa.schema([("_key", pa.int64()), ("_source", pa.string()), ("ids", pa.binary()), ("n_tokens", pa.int64())])
    tail = b"" if end is None else np.array([end], ID).tobytes()

    def run(batches):
        encode = library_encoder(path)
        rows = ((k, s, ids := encode(t) + tail, len(ids) // 2) for b in batches for k, s, t in texts_of(b, "text", "_key", "_source"))
        yield from batches_of(out, rows, weight=lambda r: len(r[2]))

    plain = docs.select(
        F.col(key).cast("bigint").alias("_key"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("_source"),
        F.col(text).cast("string").alias("text"),
    )
    return plain.mapInArrow(run, "_key bigint, _source string, ids binary, n_tokens bigint")


class Mixture:
    """Where tokens of the queues lie when windows follow each other; all queues end in the last of ``windows``.

    ``weights`` has the target share of each queue, in any unit, by default its total. Queues of weight 0 follow, in proportion
    to their totals, when the others have ended. A queue due fewer than ``least`` tokens a window gives multiples of ``least``.
    """

    def __init__(self, totals: list[int], length: int, window: int, weights: list[float] | None = None, least: int = 1):
        self.length = length
        self.totals = np.array(totals, np.int64)
        self.all = int(self.totals.sum())
        self.windows = max(1, round(self.all / (length * window)))
        asked = np.array(totals if weights is None else weights, float)
        if len(asked) != len(self.totals) or not np.isfinite(asked).all() or (asked < 0).any():
            raise ValueError("a target share is a finite number from 0, one per queue")
        later = asked == 0
        ends = np.divide(self.totals, asked, out=np.zeros(len(asked)), where=~later)
        self._start = np.where(later, ends.max(initial=0.0), 0.0)
        # The second phase lasts as long as the first, so a token is no finer a step of the clock there than it is here.
        lasting = ends.max(initial=0.0) or 1.0
        self._weight = np.where(later, self.totals / lasting, asked)
        # The clock against the tokens given by all queues: between two ends of queues both move evenly.
        end = self._start + np.divide(self.totals, self._weight, out=np.zeros(len(asked)), where=self._weight > 0)
        self._clock = np.unique(np.concatenate([[0.0], self._start, end]))
        self._sum = np.array([np.minimum(self.totals, self._weight * np.maximum(t - self._start, 0.0)).sum() for t in self._clock])
        turns = np.where(later, max(float(self.totals[later].sum()) / lasting, 1e-300), max(float(asked.sum()), 1e-300))
        due = self._weight * length * window / turns
        self._step = np.where(due < least, least, 1)
        # Rounded pieces of different queues do not fall due at once.
        self._phase = np.floor(self._step * (np.arange(1, len(asked) + 1) * 0.6180339887498949 % 1))

    def given(self, window, queue=slice(None)) -> np.ndarray:
        """Tokens each queue, or one, has given before a window or each of several."""
        clock = np.interp(np.asarray(window) * (self.all / self.windows), self._sum, self._clock)[..., None]
        totals, weight, start, step, phase = (x[queue] for x in (self.totals, self._weight, self._start, self._step, self._phase))
        exact = weight * np.maximum(clock - start, 0.0)
        whole = np.minimum((np.floor((exact + phase) / step) * step).astype(np.int64), totals)
        return np.where((exact >= totals) | (np.asarray(window)[..., None] >= self.windows), totals, whole)

    def _place(self, windows: np.ndarray, queue: int) -> np.ndarray:
        """Place on the line of all tokens where a queue begins in each of the windows."""
        found, rows = np.empty(len(windows), np.int64), max(1, CELLS // max(1, len(self.totals)))
        for i in range(0, len(windows), rows):
            w = windows[i : i + rows]
            found[i : i + rows] = self.given(w + 1, slice(0, queue)).sum(axis=1) + self.given(w, slice(queue, None)).sum(axis=1)
        return found

    def _windows(self, queue: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows in which a queue gives its tokens from ``start`` to ``end``, and what it has given before each of them."""
        slack = int(self._step[queue]) + 1
        clock = self._start[queue] + np.array([start - slack, end + slack]) / self._weight[queue]
        first, last = np.interp(clock, self._clock, self._sum) * (self.windows / self.all)
        windows = np.arange(max(0, int(first) - 1), min(self.windows, int(last) + 2))
        given = self.given(np.append(windows, windows[-1] + 1), slice(queue, queue + 1))[:, 0]
        used = (given[1:] > start) & (given[:-1] < end) & (given[1:] > given[:-1])
        return windows[used], given[:-1][used]

    def pieces(self, queue: int, start: int, size: int) -> list[tuple[int, int, int]]:
        """(start in the document, length, place on the line of all tokens) of a document at ``start`` of its queue."""
        return self.all_pieces(queue, [start], [size])[0]

    def all_pieces(self, queue: int, starts: list[int], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
        """The same for several documents of one queue."""
        found = [self._windows(queue, a, a + n) if n else (np.zeros(0, np.int64),) * 2 for a, n in zip(starts, sizes)]
        windows, back = np.unique(np.concatenate([w for w, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
        places = self._place(windows, queue)[back]
        out, i = [], 0
        for (w, given), start, size in zip(found, starts, sizes):
            begin = np.maximum(given, start)
            place = (places[i : i + len(w)] + begin - given).tolist()
            i += len(w)
            one, begin = [], (begin - start).tolist()
            for at, stop, p in zip(begin, [*begin[1:], size], place):
                while at < stop:
                    take = min(stop - at, self.length - p % self.length)
                    one.append((at, take, p))
                    at, p = at + take, p + take
            if sum(take for _, take, _ in one) != size:
                raise ArithmeticError(f"pieces of a document of {size} ids at {start} of queue {queue} do not add up to it")
            out.append(one)
        return out


def _queues(tokens: DataFrame, target: dict[str | None, float] | None) -> tuple[DataFrame, list[int], list[float] | None]:
    """``tokens`` with the number of their queue in ``_queue``; totals and target shares of the queues."""
    named = F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))
    wanted = {"" if s is None else f"={s}": float(w) for s, w in (target or {}).items()}
    if len(wanted) > QUEUES - SHARED_QUEUES:
        raise ValueError(f"a target names at most {QUEUES - SHARED_QUEUES} sources")
    totals = stage(tokens.groupBy(named.alias("_name")).agg(F.sum("n_tokens").cast("bigint").alias("_n")), "sources")
    room = QUEUES - SHARED_QUEUES
    own = [tuple(r) for r in totals.where(F.col("_name").isin(*wanted)).collect()] if wanted else []
    others = totals.where(~F.col("_name").isin(*wanted)) if wanted else totals
    own += [tuple(r) for r in others.orderBy(F.desc("_n"), "_name").limit(room - len(own)).collect()]  # QUEUES rows at most
    own.sort(key=lambda r: (-r[1], r[0]))
    spark = tokens.sparkSession
    listed = F.broadcast(spark.createDataFrame([(name, i) for i, (name, _) in enumerate(own)], "_name string, _own int"))
    shared = F.lit(len(own)) + F.pmod(F.xxhash64("_name"), F.lit(SHARED_QUEUES)).cast("int")
    number = F.coalesce("_own", shared).cast("int").alias("_queue")
    sums = [n for _, n in own]
    if totals.count() > len(own):
        rest = {r[0]: r[1] for r in totals.join(listed, "_name", "left").where("_own is null").groupBy(number).agg(F.sum("_n")).collect()}
        sums += [rest.get(len(own) + i, 0) for i in range(SHARED_QUEUES)]
    weights = [wanted.get(name, 0.0) for name, _ in own] + [0.0] * (len(sums) - len(own)) if target else None
    return tokens.withColumn("_name", named).join(listed, "_name", "left").select(*tokens.columns, number), sums, weights


def pack(tokens: DataFrame, *, length: int = SEQUENCE, window: int = WINDOW_SEQUENCES, target: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents: _key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``tokens`` as :func:`token_rows` gives it, stored. ``target`` has the share of tokens, in any unit, a window is to take from
    each source; without it sources keep their shares of the corpus. A source that has ended leaves its share to the others,
    and sources without a share follow when all with one have ended. The order within a queue is that of a hash of the keys.
    Ids move once, to sort them by queue; a hot source is many slices. Repeated keys are documents of their own. Without ids
    there is no row.
    """
    queued, totals, weights = _queues(tokens, target)
    plan = Mixture(totals, length, window, weights, LEAST_PIECE)
    placed = running_total(queued, ["_queue"], "n_tokens", ["_key", "ids"], n_rows=tokens.count(), alias="_start")
    out = pa.schema([
        ("_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()),
    ])

    def cut(batches):
        def rows():
            for batch in batches:
                keys, sources, queues, starts, sizes = (c.to_pylist() for c in batch.columns[:-1])
                of = np.array(queues)
                for queue in np.unique(of).tolist():
                    at_rows = np.flatnonzero(of == queue).tolist()
                    found = plan.all_pieces(queue, [starts[i] for i in at_rows], [sizes[i] for i in at_rows])
                    for i, pieces in zip(at_rows, found):
                        ids = np.frombuffer(batch.column(5)[i].as_buffer(), ID).astype("<u4")
                        for at, take, place in pieces:
                            yield keys[i], at, take, zlib.crc32(ids[at : at + take]), len(ids), place // length, place % length, sources[i]

        yield from batches_of(out, rows())

    schema = "_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    return placed.select("_key", "_source", "_queue", "_start", "n_tokens", "ids").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str | None = "source", length: int = SEQUENCE,
                   window: int = WINDOW_SEQUENCES, target: dict[str | None, float] | None = None, path: str | None = None) -> DataFrame:
    """Whole documents packed: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source of each piece."""
    tokens = stage(token_rows(docs, key=key, text=text, source=source, path=path), "tokens")
    return pack(tokens, length=length, window=window, target=target).withColumnRenamed("_key", key)
