"""Exact BPE encoding by backtracking, and decoding by an offset table.

The merges of a byte-pair encoding are never replayed. A text piece is cut by the longest vocabulary entries an Aho-Corasick
automaton finds, from left to right; a cut is right if and only if every two neighbours are *compatible*, that is if merging
them as one piece would leave just these two. Where no compatible entry fits, the last one is taken back and a shorter one
tried. Each prefix of a piece has one encoding only, so a position that was left once is never entered again, and the work is
linear in the length of the piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbook.llm.common import batches_of, prepare, texts_of
from reelbook.llm.tokens import ID, Latin, byte_symbols, word_tokenizer_path

#: The last symbol of a piece is a symbol of its own, this far above the plain one.
_LAST = 0x1000
#: Pairs a Python worker remembers in the compatibility table.
REMEMBERED_PAIRS = 2_000_000


class Backtracking:
    """Encoder of pieces by the tables of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def symbols(token: str) -> str:
            if not (suffix and token.endswith(suffix)):
                return token
            token = token[: -len(suffix)]
            return token[:-1] + chr(ord(token[-1]) + _LAST)

        self.spelled = {i: symbols(t) for t, i in vocab.items()}
        self.length = {i: len(s) for i, s in self.spelled.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            whole = vocab[(a.removesuffix(suffix) if suffix else a) + b]
            if whole in self.parts or self.made.get(left, -1) >= r or self.made.get(right, -1) >= r:
                raise ValueError("a token must have one merge, after those of its parts")
            self.rank[left, right] = r
            self.parts[whole], self.made[whole] = (left, right), r
        usable = {i for i, s in self.spelled.items() if i in self.parts or len(s) == 1}
        by_text = {self.spelled[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for text, i in by_text.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        #: The longest entry that is a proper prefix of each entry.
        self.shorter: dict[int, int | None] = {}
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), None)
        self._spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one edge of a token while it grows: (part, rank of the merge that consumes it)."""
        found = self._spines.get((token, side))
        if found is None:
            found, until, part = [], float("inf"), token
            while True:
                found.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.made[part], self.parts[part][side]
            self._spines[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the symbols of ``a`` and ``b`` as one piece are merged into just ``a`` and ``b``.

        They are not if some merge across the border comes first: its left part not yet consumed, nor its right part,
        where of equal ranks the left place goes first.
        """
        if len(self._pairs) >= REMEMBERED_PAIRS:
            self._pairs.clear()
        rank, right = self.rank, self._spine(b, 0)
        fits = self._pairs[a, b] = not any(
            (r := rank.get((x, y))) is not None and r < x_until and r <= y_until
            for x, x_until in self._spine(a, 1)
            for y, y_until in right
        )
        return fits

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece spelled in byte symbols."""
        if not piece:
            return []
        piece = piece[:-1] + chr(ord(piece[-1]) + _LAST)
        size = len(piece)
        longest: list[int | None] = [None] * size
        length, shorter, pairs = self.length, self.shorter, self._pairs
        for end, token in self.automaton.iter(piece):
            start = end + 1 - length[token]
            longest[start] = token  # ends come in ascending order, so the last one is the longest
        taken: list[int] = []
        dead = bytearray(size + 1)
        at, token, last = 0, longest[0], None
        while True:
            while token is not None:
                if not dead[at + length[token]]:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token is None:
                if not taken:
                    raise ValueError("the vocabulary lacks a symbol of the piece")
                dead[at] = 1
                token = taken.pop()
                at -= length[token]
                token, last = shorter[token], taken[-1] if taken else None
                continue
            taken.append(token)
            at += length[token]
            if at == size:
                return taken
            token, last = longest[at], token


class OffsetTable:
    """Decoder: all token texts in one byte string, a separator after each, with the offset where each starts."""

    def __init__(self, tokens: dict[int, str], separator: str = " "):
        self._tail = len(separator.encode())
        spelled = [tokens.get(i, "").encode() + separator.encode() if i in tokens else b"" for i in range(max(tokens) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of the decoded text, in pieces."""
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)].astype(np.int64)
            sizes = self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(sizes)
            total = int(ends[-1])
            places = np.arange(total, dtype=np.int64) + np.repeat(self.offsets[part] - (ends - sizes), sizes)
            text = self.blob[places].tobytes()
            yield text[: total - self._tail] if at + (1 << 18) >= len(ids) else text


class Codec:
    """A tokenizer file read as tables: encode whole texts, decode ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self._pieces = Tokenizer.from_file(path)  # its normaliser and splitter only
        self._specials = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._specials, key=len, reverse=True))) + ")") if self._specials else None
        self._bytes = byte_symbols()
        self.bpe = Backtracking(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self._specials.items()}
        self.table = OffsetTable(tokens)
        self.decimal = [b"%d" % i for i in range(max(tokens) + 1)]
        self.encode = Latin(self._word, self._whole)

    def _word(self, word: str) -> list[int]:
        return self.bpe.encode("".join(map(self._bytes.__getitem__, word.encode())))

    def _whole(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self._specials:
                ids.append(self._specials[part])
                continue
            normal = self._pieces.normalizer.normalize_str(part)
            for piece, _ in self._pieces.pre_tokenizer.pre_tokenize_str(normal):
                ids.extend(self.bpe.encode(piece))
        return ids


@cache
def codec(path: str | None = None) -> Codec:
    """The tables of a tokenizer file, once per Python worker."""
    return Codec(path or word_tokenizer_path())


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every whole text: key, ids (little-endian two-byte integers), n_tokens.

    A null text is empty. Rows are independent: nothing is shuffled, and a lost task is simply run again.
    """
    prepare(docs.sparkSession)
    out = pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        encode = codec(path).encode
        rows = ((k, ids := encode(t), len(ids) // 2) for b in batches for k, t in texts_of(b, "text", "key"))
        yield from batches_of(out, rows, weight=lambda r: len(r[1]))

    plain = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "key bigint, ids binary, n_tokens bigint").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, *, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Text of every row of ids as :func:`encode_texts` gives them: key, text."""
    prepare(encoded.sparkSession)
    out = pa.schema([("key", pa.int64()), ("text", pa.string())])

    def run(batches):
        table = codec(path).table
        rows = (
            (k, b"".join(table.decode(np.frombuffer(ids or b"", ID))).decode())
            for b in batches
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        )
        yield from batches_of(out, rows, weight=lambda r: len(r[1]))

    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, "key bigint, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Digests of the ids and of the text decoded from them: key, n_tokens, ids_sha256, decoded_sha256.

    Every row of ``docs`` gives one row, repeated keys included. Encoded and decoded in one pass, so no ids are moved.
    """
    prepare(docs.sparkSession)
    out = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(key_value, text_value, tool: Codec):
        ids = np.frombuffer(tool.encode(text_value), ID)
        listed = hashlib.sha256()
        for at in range(0, len(ids), 1 << 18):
            listed.update((b" " if at else b"") + b" ".join(map(tool.decimal.__getitem__, ids[at : at + (1 << 18)].tolist())))
        decoded = hashlib.sha256()
        for part in tool.table.decode(ids):
            decoded.update(part)
        return key_value, len(ids), listed.hexdigest(), decoded.hexdigest()

    def run(batches):
        tool = codec(path)
        yield from batches_of(out, (digest(k, t, tool) for b in batches for k, t in texts_of(b, "text", "key")))

    plain = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
