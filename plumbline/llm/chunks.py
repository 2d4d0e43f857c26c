"""Cutting texts where byte-level BPE can never merge, and caching what each cut gives.

The pattern of the vocabularies begins a match at every blank that a non-blank follows: the
blank can only open a match or end a run of white space, and ``\\s+(?!\\S)`` gives it back.
So the ids of a text are those of its chunks in order.  Python's ``\\s`` covers all Unicode
white space, so cuts are never made where another engine would see white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CUT = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" (?=\s)| \Z")
GENERATION = 600_000
CACHED_CHARS = 64


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; every one but the first has lost the blank that it begins with."""
    return CUT.split(text) if UNSAFE.search(text) else text.split(" ")


class ChunkCache(dict):
    """chunk -> little-endian ids of (prefix + chunk), in two generations of bounded size.

    A full generation becomes the old one, from which chunks that are met again move up, so
    frequent chunks stay.  Long chunks are not kept.
    """

    def __init__(self, prefix: str, encode: Callable[[str], bytes]):
        super().__init__()
        self.prefix, self.encode = prefix, encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.compute(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def compute(self, chunk: str) -> bytes:
        return self.encode(self.prefix + chunk)


class BlankChunks(ChunkCache):
    """Chunks behind a blank.  A run of letters, and one with a comma or full stop, need no pattern:
    the pattern matches the blank with the letters, and the mark on its own.  A run of letters is kept
    here only, and found by the same run with a mark."""

    def __init__(self, encode: Callable[[str], bytes], pieces: ChunkCache):
        super().__init__(" ", encode)
        self.pieces = pieces

    def compute(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.pieces.encode(" " + chunk)
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.pieces[chunk[-1]]
        return self.encode(" " + chunk)


class TextEncoder:
    """Encode whole texts chunk by chunk, and chunks piece by piece.

    ``matches`` lists the pieces of a chunk, ``piece`` gives the ids of one.
    """

    def __init__(self, matches: Callable[[str], list[str]], piece: Callable[[str], bytes]):
        pieces = ChunkCache("", piece)

        def encode(chunk: str) -> bytes:
            return b"".join(map(pieces.__getitem__, matches(chunk)))

        self.first, self.rest = ChunkCache("", encode), BlankChunks(encode, pieces)

    def __call__(self, text: str) -> bytes:
        head, *tail = chunks_of(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
