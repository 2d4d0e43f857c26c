"""Byte-level BPE as a monoid: encode halves, join neighbours, decode by concatenation.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are the
encoding of their own bytes.  Two encodings are therefore joined by re-encoding a window
around the seam, which grows until both of its edges pass that test with the tokens outside;
those outside can then no longer change.  The join is associative with the empty sequence as
identity, so halves may be encoded in any order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import TextEncoder
from .common import table

LEAF_BYTES = 8
SHORT_BYTES = 96
NO_RANK = 1 << 62
CACHED = 300_000
IDS = np.dtype("<u4")


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a .tiktoken file (each line: base64 token, id)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines if line.strip())}


class Monoid:
    """Encodings of byte strings under one vocabulary, with their join."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self.leaves: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merge the lowest-ranked pair, the leftmost first, until none is left."""
        return self._merge_short(data) if len(data) <= SHORT_BYTES else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        found = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while found and (low := min(found)) != NO_RANK:
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
            if i < len(found):
                found[i] = rank(parts[i] + parts[i + 1], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows of any length."""
        n, ranks = len(data), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(data[i : end[j]]) if j < n else None

        heap = [(r, i, end[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; the same two tokens if they are stable."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            found = self.pairs[key] = tuple(self.merge(self.token[left] + self.token[right]))
        return found

    def stable(self, left: int, right: int) -> bool:
        return self.pair(left, right) == (left, right)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        width, window = 1, self.pair(left[-1], right[0])
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            if (a == 0 or self.stable(left[a - 1], window[0])) and (
                b == len(right) or self.stable(window[-1], right[b])
            ):
                return [*left[:a], *window, *right[b:]]
            width *= 2
            window = self.merge(self.bytes_of(left[-width:]) + self.bytes_of(right[:width]))

    def encode(self, data: bytes) -> list[int]:
        """The join of the encodings of both halves, down to leaves of a few bytes."""
        if len(data) > LEAF_BYTES:
            half = len(data) // 2
            return self.join(self.encode(data[:half]), self.encode(data[half:]))
        found = self.leaves.get(data)
        if found is None:
            if len(self.leaves) >= CACHED:
                self.leaves.clear()
            found = self.leaves[data] = self.merge(data)
        return found

    def piece(self, data: bytes) -> list[int]:
        """A piece that is a token as a whole is that token; others are encoded."""
        whole = self.ranks.get(data)
        return self.encode(data) if whole is None else [whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenation up the tree; both halves of any cut decode on their own."""
        if len(ids) <= 1 << 16:
            return self.bytes_of(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], tuple[TextEncoder, Monoid]] = {}


def codec(ranks_path: str, pattern: str) -> tuple[TextEncoder, Monoid]:
    """Encoder and monoid of a vocabulary, kept for the life of a Python worker."""
    key = (ranks_path, pattern)
    if key not in _LOADED:
        import regex

        monoid, pieces = Monoid(load_ranks(ranks_path)), regex.compile(pattern)

        def piece(text: str) -> bytes:
            return array("I", monoid.piece(text.encode("utf-8"))).tobytes()

        _LOADED[key] = TextEncoder(pieces.findall, piece), monoid
    return _LOADED[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def encode_documents(
    docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True
) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids.

    Digests are of the ids as little-endian uint32 and of the bytes that the ids decode to.
    A null text is the empty text: no token, digests of nothing.  A null doc_id is kept, and so
    are repeated rows; an empty table gives an empty result; other columns are ignored.  Texts
    are encoded whole: a long run without blanks is halved and joined.  No shuffle.
    """
    if ranks_path is None:
        ranks_path, pattern = default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, monoid = codec(ranks_path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                ids = encoder(text.as_py() or "")
                decoded = monoid.decode(np.frombuffer(ids, IDS))
                rows.append((ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            lengths = [len(ids) // IDS.itemsize for ids, _, _ in rows]
            columns = [
                batch.column(0),
                pa.array(lengths, pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.frombuffer(b"".join(r[0] for r in rows), IDS).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
