"""Exact ids of a word-level byte BPE tokenizer, with a bounded memory of words."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: Distinct words a generation of a Python worker's memory holds.
REMEMBERED_WORDS = 400_000
#: Id appended to each document where a contract asks for an end.
END_ID = 2
#: Ids are kept in two bytes.
ID = np.dtype("<u2")


def word_tokenizer_path() -> str:
    """Place of the public vocabulary used by the queries; found on whichever machine runs the task."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordMemory(dict):
    """word -> its ids as bytes, made by ``encode`` when first seen.

    Two generations bound it: when the younger is full it becomes the older, and the older one's words are forgotten unless
    they were seen again.
    """

    def __init__(self, encode):
        super().__init__()
        self._encode = encode
        self._older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = np.array(self._encode(word), ID).tobytes()
        if len(self) >= REMEMBERED_WORDS:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids


#: The tokenizer's own split, spelled out for the first 256 code points (fixed values): contractions, letters, a digit, others.
_LETTERS, _DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Texts with these go the library's way.
_ODD = re.compile("<\\||[\x1c-\x1f]")


class Latin:
    """Encodes texts of the first 256 code points word by word, any other text by ``whole``.

    On those code points the normaliser only lowers case and unifies white space, so words are independent of each other.
    """

    def __init__(self, encode_word, encode_whole):
        self._words = WordMemory(encode_word)
        self._whole = encode_whole

    def __call__(self, text: str) -> bytes:
        """Ids of a whole text as little-endian two-byte integers."""
        plain = text.isascii()
        if not plain:
            try:
                text.encode("latin-1")
                plain = True
            except UnicodeEncodeError:
                pass
        if not plain or _ODD.search(text):
            return np.asarray(self._whole(text), ID).tobytes()
        return b"".join(map(self._words.__getitem__, LATIN_WORDS.findall(text.lower())))


def byte_symbols() -> list[str]:
    """Printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@cache
def library_encoder(path: str | None = None) -> Latin:
    """Encoder whose words and odd texts are encoded by the tokenizers library; one per Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or word_tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids need two bytes here")

    def encode(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    symbols, model = byte_symbols(), tokenizer.model

    def encode_word(word: str) -> list[int]:
        piece = word if word.isalpha() and word.isascii() else "".join(map(symbols.__getitem__, word.encode()))
        return [t.id for t in model.tokenize(piece)]

    return Latin(encode_word, encode)
