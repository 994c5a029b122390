"""Encoding whole texts by a byte-level BPE, with repeated chunks encoded once.

A single space between two non-space characters always starts a new pre-token of the
pattern that public byte-level vocabularies use, whatever stands around it.  Chunks
between such spaces can therefore be encoded alone and joined without changing any id.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import regex

_CUT = re.compile(r" (?<=\S )(?=\S)")
LONGEST_KEPT = 64
MOST_KEPT = 300_000

# The bytes that byte-level vocabularies show as themselves; the others,
# in ascending order, are shown as the characters from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """The printable character that stands for each of the 256 byte values."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    place = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(place.get(b, b)) for b in range(256)]


SHOW = dict(enumerate(byte_characters()))


def shown(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", SHOW[32])
    return text.encode().decode("latin-1").translate(SHOW)


@contextmanager
def without_collector():
    """Large dictionaries of strings hold no cycles; walking them again and again costs most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class ChunkEncoder:
    """Maps texts to the bytes of their ids: unsigned integers of 16 bits (kind "H") or 32 ("I").

    ``encode`` maps a list of byte-mapped pre-tokens to one list of ids each.  A bounded
    number of short chunks is remembered from batch to batch.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[list[int]]], kind: str):
        self.pattern = regex.compile(pattern)
        self.encode = encode
        self.kind = kind
        self.kept: dict[str, bytes] = {}

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        # Letters alone, after one space or none, are a single pre-token.
        parts = [[c] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.pattern.findall(c) for c in chunks]
        new = list({p for part in parts for p in part})
        ids = dict(zip(new, (array(self.kind, x).tobytes() for x in self.encode([shown(p) for p in new])), strict=True))
        return [b"".join(map(ids.__getitem__, part)) for part in parts]

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = [_CUT.split(text or "") for text in texts]
        heads = self._fresh([x[0] for x in cut])
        words: set[str] = set()
        for x in cut:
            words.update(x[1:])
        if len(self.kept) > MOST_KEPT:
            self.kept = {x: self.kept[x] for x in words if x in self.kept}
        kept = self.kept
        new = [x for x in words if x not in kept]
        kept |= zip(new, self._fresh([" " + x for x in new]), strict=True)
        out = [a + b"".join(map(kept.__getitem__, x[1:])) for a, x in zip(heads, cut, strict=True)]
        for x in new:
            if len(x) > LONGEST_KEPT:
                del kept[x]
        return out


class PieceEncoder(dict):
    """As ChunkEncoder, for a library that encodes one pre-token a call: chunks are encoded when first met.

    The dictionary maps chunks, without the space before them, to the bytes of their ids.
    """

    def __init__(self, pattern: str, encode: Callable[[str], list[int]], kind: str):
        self.pattern = regex.compile(pattern)
        self.encode = encode
        self.kind = kind

    def _ids(self, text: str) -> bytes:
        return b"".join(array(self.kind, self.encode(shown(p))).tobytes() for p in self.pattern.findall(text))

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():  # letters after one space are a single pre-token
            ids = array(self.kind, self.encode(SHOW[32] + chunk if chunk.isascii() else shown(" " + chunk))).tobytes()
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # and so is a mark after them
            ids = self[chunk[:-1]] + self._ids(chunk[-1])
        else:
            ids = self._ids(" " + chunk)
        if len(chunk) <= LONGEST_KEPT:
            self[chunk] = ids
        return ids

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self) > MOST_KEPT:
            self.clear()
        out = []
        for text in texts:
            head, *tail = _CUT.split(text or "")
            out.append(self._ids(head) + b"".join(map(self.__getitem__, tail)))
        return out
