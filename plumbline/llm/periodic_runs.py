"""Periodic runs of words in whole texts, found by minimizers at several scales.

A run is a stretch of words with least period q that is at least max(12, 2q) words long and that
no neighbouring word extends.  The texts of an Arrow batch are laid end to end as arrays of word
numbers, parted by numbers that occur once, so that every step works on whole arrays:

* Periods below 16: for each, one scan of the words that equal the word so many places later.
* Periods from P to 2P, for P = 16, 32, ...: a run holds two equal windows of P - 1 words, q apart.
  Windows choose the least hash of their P/2-grams, so the same P/2-gram is chosen in both, q
  apart.  Chosen places with equal hashes and a distance from P to 2P are seeds, and each seed is
  extended word by word to the whole stretch that repeats at this distance.
* P/2-grams that are periodic themselves with at most P/4 are never chosen: they lie in runs that
  are known from lower scales.  All others with one hash are more than P/4 apart, so a place has at
  most eight partners, and the work is near n log n for any text.  A run whose whole first period
  lies in one such lower run leaves no seed; it has a border of two lower runs of one period in
  it, and every distance that lines up both sides of a border is a further seed.

Hashes only propose: stretches are compared word by word, and a stretch counts only with its least
period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import space_words, table
from .shingles import mix

LEAST_LENGTH = 12
SCANNED = 16
#: A periodic 8-gram, the shortest gram of a scale, has a run of at least eight words.
KNOWN_LENGTH = SCANNED // 2
#: Texts are taken together up to so many bytes; a longer text is taken alone.
BATCH_BYTES = 1 << 22
BLOCK_CELLS = 1 << 20

_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "starts array<long>, lengths array<long>, periods array<long>, collapsed binary"
)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _is_least(words: np.ndarray, start: int, q: int) -> bool:
    """Whether a stretch of at least 2q words with period q has no smaller period."""
    block = words[start : start + q]
    return not any(np.array_equal(block[d:], block[:-d]) for d in (q // p for p in _prime_factors(q)))


def _scanned(words: np.ndarray) -> list[np.ndarray]:
    """Runs (start, length, period) of all periods below 16 and at least eight words."""
    runs = []
    for q in range(1, min(SCANNED, len(words))):
        start, end = _stretches(words[:-q] == words[q:])
        long = end - start >= max(q, KNOWN_LENGTH - q)
        start, length = start[long], (end - start)[long] + q
        if len(start):
            # a smaller period divides q, and then the first q words repeat at it
            least = np.ones(len(start), bool)
            for d in (q // p for p in _prime_factors(q)):
                at = start[:, None] + np.arange(q - d)
                least &= (words[at] != words[at + d]).any(axis=1)
            runs.append(np.stack([start[least], length[least], np.full(least.sum(), q)], axis=1))
    return runs


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (min or max) of every ``width`` neighbours, width a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width`` places."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    ends = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((ends, least, ends)), width, np.maximum)
    return np.flatnonzero((hashes == most) & (hashes < _NEVER))


def _pairs(hashes: np.ndarray, places: np.ndarray, scale: int) -> np.ndarray:
    """Seeds (distance, place) from places with equal hashes, distance from scale to 2 scale."""
    order = np.argsort(hashes[places], kind="stable")
    places, keys = places[order], hashes[places][order]
    seeds, ahead = [], 1
    while ahead < len(places):
        apart = places[ahead:] - places[:-ahead]
        same = (keys[ahead:] == keys[:-ahead]) & (apart < 2 * scale)
        if not same.any():
            break
        far = same & (apart >= scale)
        seeds.append(np.stack([apart[far], places[:-ahead][far]], axis=1))
        ahead += 1
    return np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)


def _borders(words: np.ndarray, known: np.ndarray, scale: int) -> np.ndarray:
    """Seeds at the borders of neighbouring runs with one period of at most scale / 4."""
    low = known[known[:, 2] <= scale // 4]
    low = low[np.lexsort((low[:, 0], low[:, 2]))]
    a, b = low[:-1], low[1:]
    both = np.minimum(a[:, 1], b[:, 1])
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 0] + a[:, 1]) & (both >= scale)
    seeds = []
    for (start, length, d), (second, more, _) in zip(a[meet], b[meet]):
        end = start + length
        root = words[second : second + d]
        for at in range(end - 2 * d + 1, end - d + 1):
            if np.array_equal(words[at : at + d], root):
                first = scale + (second - at - scale) % d
                lags = np.arange(first, min(2 * scale - 1, length, more) + 1, d)
                seeds.append(np.stack([lags, end - lags], axis=1))
                break
    return np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)


def _matching(words: np.ndarray, at: np.ndarray, lag: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many places from ``at`` on (backwards for way -1) equal the word ``lag`` later, up to ``most``."""
    found = np.zeros(len(at), np.int64)
    live, width = np.flatnonzero(most > 0), 16
    while len(live):
        rows = max(1, BLOCK_CELLS // width)
        going = []
        for part in (live[i : i + rows] for i in range(0, len(live), rows)):
            ahead = found[part][:, None] + np.arange(width)
            inside = ahead < most[part][:, None]
            place = at[part][:, None] + way * np.where(inside, ahead, 0)
            equal = inside & (words[place] == words[place + lag[part][:, None]])
            run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
            found[part] += run
            going.append(part[(run == width) & (found[part] < most[part])])
        live, width = np.concatenate(going), min(2 * width, 1 << 14)
    return found


def _extended(words: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of the stretches that hold a seed.

    Seeds of one distance are in order; each is compared up to the next, so a stretch is read once.
    """
    seeds = np.unique(seeds, axis=0)
    lag, at = seeds[:, 0], seeds[:, 1]
    following = np.append(lag[1:] == lag[:-1], False)
    room = len(words) - lag - at
    upto = np.where(following, np.append(at[1:], 0) - at, room)
    ahead = _matching(words, at, lag, upto, 1)
    joined = following & (ahead == upto)
    first = np.append(True, ~joined[:-1])
    back = np.zeros(len(at), np.int64)
    begins = np.flatnonzero(first)
    back[begins] = _matching(words, at[begins] - 1, lag[begins], at[begins], -1)
    ends = np.flatnonzero(~joined)
    start, end, q = at[begins] - back[begins], at[ends] + ahead[ends], lag[begins]
    long = end - start >= q
    runs = {(int(s), int(e - s + p), int(p)) for s, e, p in zip(start[long], end[long], q[long])}
    return [r for r in sorted(runs) if _is_least(words, r[0], r[2])]


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start and period.

    ``words`` are word numbers (int64); a negative number must occur once and parts texts of at
    most ``longest`` words.
    """
    known = _scanned(words)
    known = np.concatenate(known) if known else np.empty((0, 3), np.int64)
    gram, width = mix(words.astype(np.uint64) * _FACTOR), 1
    parted = words < 0
    scale = SCANNED
    while 2 * scale <= longest:
        half = scale // 2
        while width < half:
            if len(gram) <= width:
                break
            gram = mix(gram[:-width] * _FACTOR + gram[width:])
            parted = parted[:-width] | parted[width:]
            width *= 2
        low = known[(known[:, 2] <= scale // 4) & (known[:, 1] >= half)]
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, low[:, 0], 1)
        np.add.at(inside, low[:, 0] + low[:, 1] - half + 1, -1)
        hidden = parted | (np.cumsum(inside)[: len(gram)] > 0)
        hashes = np.where(hidden, _NEVER, gram)
        seeds = np.concatenate([_pairs(hashes, _chosen(hashes, half), scale), _borders(words, known, scale)])
        if len(seeds):
            found = _extended(words, seeds)
            if found:
                known = np.concatenate([known, np.array(found, np.int64)])
        scale *= 2
    known = known[known[:, 1] >= LEAST_LENGTH]
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts with a negative number after each, the places where texts start, words."""
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    flat = split.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)[filled]
    words = flat.filter(pa.array(filled))
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = np.bincount(row, minlength=len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    laid = -1 - np.arange(len(numbers) + len(texts), dtype=np.int64)
    laid[np.arange(len(numbers)) + row] = numbers
    return laid, starts, words


def _described(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, starts, values = _numbered(texts)
    sizes = np.diff(np.append(starts, len(words))) - 1
    runs = find_runs(words, int(sizes.max()))
    doc = np.searchsorted(starts, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    left = (np.cumsum(dropped[:-1]) == 0)[words >= 0]
    doc_of_word = np.repeat(np.arange(len(texts)), sizes)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(doc_of_word[left], minlength=len(texts)))))
    kept = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.filter(pa.array(left)))
    collapsed = pc.binary_join(kept, " ").cast(pa.binary())
    columns = {f.split()[0]: [] for f in RESULT.split(", ")[2:-1]}
    for i in range(len(texts)):
        own = runs[bounds[i] : bounds[i + 1]] - [starts[i], 0, 0]
        best = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist() if len(own) else [None] * 3
        row = [len(own), *best, 1000 * best[1] // best[2] if len(own) else None, *(own.T.tolist() if len(own) else [[]] * 3)]
        for column, value in zip(columns.values(), row):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
    arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds)]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *arrays, collapsed], names=names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the longest run, all runs (by start, then period), collapsed text.

    The longest run is the first of least period among ties; without runs its four columns are
    null and the arrays empty.  ``collapsed`` is the UTF-8 text of the words that are in no run after
    its first period, one space apart.  Null and blank texts have no words.  Rows are taken one by
    one: repeated rows repeat, null doc_ids stay, an empty table gives an empty result, and other
    columns are ignored.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            ends = np.cumsum(pc.add(pc.binary_length(texts), 1).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
                yield _described(batch.column(0).slice(at, upto - at), texts.slice(at, upto - at))
                at = upto

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(describe, RESULT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's change of one text in ten, whose words from a on repeat with period p.

    Texts without words and rows without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.when(F.col("doc_id").isNotNull() & (h % 10 == 0), space_words(F.col("text"))).alias("words"),
    )
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    changed = F.slice(F.concat(F.slice("words", 1, F.col("a")), again), 1, n)
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    triples = F.transform(
        F.arrays_zip("starts", "lengths", "periods"),
        lambda r: F.concat_ws(",", r.starts.cast("string"), r.lengths.cast("string"), r.periods.cast("string")),
    )
    listed = F.concat(F.array_join(triples, "\n"), F.when(F.col("n_runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
