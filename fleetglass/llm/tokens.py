"""Token ids of whole texts, cheap enough for a corpus: each distinct chunk of a slice is encoded once.

A text is cut before every run of ASCII spaces that follows something else, between a Latin letter and an ASCII sign or
digit, and behind a line end that stands alone between other characters. No match of these vocabularies' split patterns
crosses such a cut, so the ids of the text are those of its chunks, one after the other. Texts that hold other Unicode
spaces, whose runs could cross a cut, stay whole. Null texts count as empty and have no ids.

Chunks that are one word of Latin letters are one match of the pattern, so they go to the library's model without its
splitting; all others take the library's whole way.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import _SPACE, held, lowered, utf8

CACHE_ENTRIES = 250_000
TOKEN_SLICE = 9 << 20
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[33:127] = ~_ASCII_LETTER[33:127]


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a space character outside ASCII's common six."""
    at = np.flatnonzero(_LEAD[data])
    if not len(at):
        return at
    padded = np.concatenate([data, np.zeros(2, dtype=np.uint8)])
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    hit = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks begin inside rows without odd spaces."""
    space, letter = _SPACE[data], _ASCII_LETTER[data]
    # the second byte of U+00C0 to U+00FF, which are letters but for two signs
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = space[1:] & ~space[:-1] | letter[:-1] & _SIGN[data[1:]]
    cut[2:-1] |= (data[1:-1] == 0x0A) & ~space[:-2] & ~space[2:]
    return cut


def chunks(column: pa.Array, bare: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the number of the chunk at each place, and how many places precede each row.

    With ``bare`` the chunks come without ASCII spaces and with a-z for A-Z, for vocabularies that know neither.
    """
    data, offsets = utf8(column)
    if not len(data):
        return [], np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    cut, odd = _cuts(data), odd_rows(data, offsets)
    for row in odd:
        cut[offsets[row] : offsets[row + 1]] = False
    cut[offsets] = True
    cut[-1] = True
    bounds = np.flatnonzero(cut)
    row_at = np.searchsorted(bounds, offsets)
    if bare:
        stays = ~_SPACE[data]
        for row in odd:
            stays[offsets[row] : offsets[row + 1]] = True
        # a letter before a character that may be a combining mark keeps its case: the library composes first
        after = np.append(data[1:], np.uint8(0))
        data = np.where((after < 0x80) | (after == 0xC3), lowered(data), data)[stays]
        bounds = np.concatenate([[0], np.cumsum(stays)])[bounds]
    parts = pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), row_at


class Recent(dict):
    """A bounded cache: when it is full, what was not used since it was last full goes."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.older = entries, {}

    def missing(self, keys: list) -> list:
        """The keys not known; the others are in the cache until the next call."""
        if len(self) > self.entries:
            self.older = dict(self)
            self.clear()
        new = []
        for k in keys:
            if k not in self:
                if (found := self.older.get(k)) is None:
                    new.append(k)
                else:
                    self[k] = found
        return new


class Encoder:
    """Ids of the rows of string columns; ``encode`` takes distinct chunks and gives each one's ids as uint32 bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bare: bool = False, entries: int = CACHE_ENTRIES):
        self.encode, self.bare, self.known = encode, bare, Recent(entries)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, and where each row's begin (one more than rows)."""
        distinct, codes, row_at = chunks(column, self.bare)
        if new := self.known.missing(distinct):
            self.known.update(zip(new, self.encode(new), strict=True))
        found = [self.known[x] for x in distinct]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(size) - size
        lengths = size[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])] if ends[-1] else flat[:0], ends[row_at]


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is a visible Latin-1 character, else as 256 and more."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}


def _word_form(config: dict) -> tuple[Callable[[str], str | None] | None, bool]:
    """How a word of Latin letters reads in the vocabulary (None: unknown), and whether spaces and case don't count there."""
    pre, normal, letters = config["pre_tokenizer"] or {}, config["normalizer"], _byte_letters()
    steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and normal is None:
        bare = False
    elif steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed":
        bare = True
    else:
        return None, False

    def form(chunk: str) -> str | None:
        word = chunk.lower() if bare else chunk.removeprefix(" ")
        if not word.isalpha():
            return None
        if word.isascii():
            return word if bare or len(word) == len(chunk) else letters[32] + word
        if max(word) > "\u00ff":
            return None
        return "".join(map(letters.__getitem__, (word if bare else chunk).encode()))

    return form, bare


def library_encoder(path: str) -> Encoder:
    """An encoder over the tokenizers library, one for each vocabulary file and worker; special strings are plain text."""

    def make() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            form, bare = _word_form(json.load(file))
        model = tokenizer.model

        def whole(texts: list[str]) -> list[bytes]:
            out = []
            for at in range(0, len(texts), 4096):
                out += [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
            return out

        def encode(texts: list[str]) -> list[bytes]:
            if form is None:
                return whole(texts)
            out = [None if (w := form(x)) is None else array("I", [t.id for t in model.tokenize(w)]).tobytes() for x in texts]
            others = [k for k, ids in enumerate(out) if ids is None]
            for k, ids in zip(others, whole([texts[k] for k in others]), strict=True):
                out[k] = ids
            return out

        return Encoder(encode, bare)

    return held(path, make)


def crc(ids: np.ndarray) -> int:
    """The unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
