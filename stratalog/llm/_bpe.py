"""Byte-level BPE by the ``tokenizers`` library, one call for each distinct piece of text.

A byte-level tokenizer of this kind first cuts a text into pieces (runs of letters, digits, other signs or white space)
and encodes each by itself. Pieces are found here with one pattern, the library's model encodes each distinct one when
it is first met, and a worker keeps the ids of a bounded number of them. Tokens that were added to the vocabulary, such
as its end of text, are pieces of their own where a text holds them. A vocabulary file with another pre-tokenizer, a
normalizer or added tokens that take in their surroundings is left to the library, a call for each text.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

END_ID = 0
#: Unicode's white space, as the pattern of the vocabulary means it.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points that are encoded together; a longer text is cut between words.
CHUNK_CHARS = 1 << 20
#: Distinct pieces and their ids that a worker keeps; beyond either it starts anew.
_PIECES, _POOL_IDS = 1 << 19, 1 << 23


def _classes(last: int) -> tuple[str, str, str]:
    """Letters, numbers and white space up to a code point, as the inside of a set in a pattern."""
    import regex

    every = "".join(chr(i) for i in range(last + 1) if not 0xD800 <= i < 0xE000)
    span = lambda a, b: f"\\U{ord(a):08x}-\\U{ord(b):08x}"
    runs = lambda p: "".join(span(run[0], run[-1]) for m in regex.finditer(p, every) for run in _unbroken(m[0]))
    return runs(r"\p{L}+"), runs(r"\p{N}+"), "".join(span(chr(i), chr(i)) for i in _WHITE)


def _unbroken(run: str) -> list[str]:
    """A run that goes on behind the surrogates, which no text holds, as two."""
    at = next((i for i, c in enumerate(run) if c >= ""), 0)
    return [run[:at], run[at:]] if at and run[0] < "\ud800" else [run]


@lru_cache(maxsize=2)
def _patterns(last: int) -> tuple[re.Pattern, re.Pattern]:
    """What finds pieces, and where a word ends, in texts without code points above ``last``.

    Letters come first, being the most frequent; no other piece begins like them.
    """
    letter, number, space = _classes(last)
    piece = rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(piece), re.compile(rf"(?<=[^{space}])[{space}]")


_ABOVE = re.compile("[\U00010000-\U0010ffff]")


def _pattern(text: str) -> tuple[re.Pattern, re.Pattern]:
    """Sets without code points above 0xFFFF are much faster, and enough for nearly every text."""
    return _patterns(0x10FFFF if not text.isascii() and _ABOVE.search(text) else 0xFFFF)


def _byte_signs() -> list[str]:
    """The sign that stands for each byte: printable ones for themselves, others for the signs from 0x100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Encoder:
    """``encode(texts)`` gives each text's ids as the library does for whole texts with ``add_special_tokens=False``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added_ids = {t.content: i for i, t in added.items()}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
        self.by_pieces = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not any(told.get(k) for k in ("normalizer", "truncation", "padding")) and model.get("type") == "BPE" and not model.get("dropout")
            and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        )
        self.model, self.signs = self.library.model, {b: s for b, s in enumerate(_byte_signs())}
        self.added = re.compile("|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True))) or r"(?!)")
        self._reset()

    def _reset(self) -> None:
        encoder = self

        class Seen(dict):
            """The number of a piece; a new piece is encoded."""

            def __missing__(self, piece: str) -> int:
                return encoder._learn(piece, [t.id for t in encoder.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(encoder.signs))])

        self.seen, self.at, self.counts, self.pool = Seen(), array("q"), array("q"), array("i")
        for content, number in self.added_ids.items():
            self._learn(content, [number])

    def _learn(self, piece: str, ids: list[int]) -> int:
        number = self.seen[piece] = len(self.at)
        self.at.append(len(self.pool))
        self.counts.append(len(ids))
        self.pool.extend(ids)
        return number

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; what is before and after an added token is cut as if each were a text by itself."""
        find = _pattern(text)[0].findall
        if not any(t in text for t in self.added_ids):
            return find(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [*find(text, at, m.start()), m[0]]
            at = m.end()
        return out + find(text, at)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.seen) > _PIECES or len(self.pool) > _POOL_IDS:
            self._reset()
        found, ends = [], [0]
        for text in texts:
            found += self._pieces(text)
            ends.append(len(found))
        number = np.fromiter(map(self.seen.__getitem__, found), np.int64, len(found))
        at, counts = np.frombuffer(self.at, np.int64)[number] if len(number) else number, np.frombuffer(self.counts, np.int64)[number] if len(number) else number
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        ids = np.frombuffer(self.pool, np.int32)[np.arange(total[-1]) + np.repeat(at - total[:-1], counts)] if total[-1] else np.zeros(0, np.int32)
        return ids, total[ends]

    def _slices(self, text: str) -> Iterator[str]:
        """A long text, cut where white space follows something else: no piece goes over such a place."""
        at, ends = 0, _pattern(text)[1]
        whole = any(t in text for t in self.added_ids)
        while at < len(text):
            m = None if whole else ends.search(text, at + CHUNK_CHARS)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin, with the end."""
        if not self.by_pieces:
            got = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            parts = [self._ids([x])[0] for x in self._slices(texts[0])]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        return self._ids(texts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it stays for the worker's next tasks.

    ``vocabulary``: a path that the worker can open, or the plain name of a file that ``public_tokenizers`` finds there.
    """
    if vocabulary not in _ENCODERS:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _ENCODERS[vocabulary] = Encoder(path)
    return _ENCODERS[vocabulary]


def encoded(vocabulary: str, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids, with END_ID after them, of each text (null: empty)."""
    texts = ["" if x is None else x for x in column.to_pylist()]
    row, n = 0, len(texts)
    while row < n:
        end, size = row, 0
        while end < n and (end == row or size + len(texts[end]) <= CHUNK_CHARS):
            size += len(texts[end])
            end += 1
        ids, at = encoder(vocabulary).encode(texts[row:end])
        for i in range(row, end):
            yield i, np.append(ids[at[i - row] : at[i - row + 1]], np.int32(END_ID))
        row = end


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
