"""N-gram Jaccard join: rare-first prefixes find pairs, four filters thin them, full sets decide.

Every text becomes its set of 3-word n-grams; equal sets are one class.  Two sets link at a Jaccard
similarity of 0.9, so of n n-grams at most n / 10 are missing in a partner, and whatever one order
all sets share, partners have a common n-gram among their first n / 10 + 1: their prefixes.

1. The order: first a fixed quarter of all n-grams, chosen by hash, the rarest first; then the
   others by hash.  Counts are thus needed for a quarter only.  N-grams that only one class has come
   first, so a class with n / 10 + 1 of them has no partner and leaves; that is the common case.
   Counts and prefixes are taken among the classes that stay.
2. Prefix n-grams are joined within bands of length: sets of one bucket (n-gram, band) are tied to
   its least member, and the connected groups of ties hold every possible pair.
3. Groups are dealt into blocks of bounded size; each pair of blocks is one unit of work, in which
   a pair of sets is met once.  At its first common prefix n-gram the positional filter bounds the
   overlap by what is left behind it, with the length filter in the same bound; the suffix filter
   bounds the Hamming distance of the n-grams outside the quarter by their counts between fixed
   pivots.  Pairs that pass are verified on full sets.
4. A unit emits a spanning forest of its links, at most one row a member.

A unit is bounded, but a group of N classes needs (N / 256)^2 / 2 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components
from .shingles import mix

WIDTH = 3
LIMIT_PERCENT = 90
BLOCK_MEMBERS = 256
BLOCK_NGRAMS = 400_000
BATCH_BYTES = 1 << 22
COLUMNS = 4096
FEW_PAIRS = 256
SLICES = 16
SALTS = 16

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LAST = (1 << 63) - 1

SIGNATURE = "doc_id long, n_ngrams long, digest binary, first array<long>, rest array<long>"


def prefix_length(n: int) -> int:
    """So many n-grams of a set of n hold one that any partner has, whatever the order."""
    return n * (100 - LIMIT_PERCENT) // 100 + 1


def is_first(ngrams: np.ndarray) -> np.ndarray:
    """Whether n-grams belong to the quarter that the order puts first."""
    return (ngrams & np.uint64(3)) == 0


def ngram_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text, A-Z lower-cased.

    A text of fewer words than three has one n-gram of them all, a text without words none.
    Arrow lower-cases and parts ASCII only; equal words of a batch are hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(split).to_numpy().astype(np.int64)
    flat = split.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)[filled]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    hashes = hashes[coded.indices.to_numpy()]
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    grams = hashes[: max(0, len(hashes) - WIDTH + 1)] * _FACTORS[0]
    for i in range(1, WIDTH):
        grams += hashes[i : i + len(grams)] * _FACTORS[i]
    grams = mix(grams)
    start = 0
    for end in ends.tolist():
        n = end - start
        if n >= WIDTH:
            yield np.unique(grams[start : end - WIDTH + 1])
        elif n:
            short = hashes[start:end] * _FACTORS[:n]
            yield mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)
        start = end


def batches_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds (from, to) of parts of at most ``BATCH_BYTES``; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield at, upto
        at = upto


def digest_of(ngrams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(ngrams.tobytes()) if len(ngrams) else None


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: size and digest of the set, its n-grams of the first quarter, and as many of the
    others, by hash, as its prefix would need if the quarter is too small for it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in batches_of(texts):
                columns: list[list] = [[], [], [], []]
                for found in ngram_sets(texts.slice(a, b - a)):
                    quarter = is_first(found)
                    first, others = found[quarter].view(np.int64), np.sort(found[~quarter].view(np.int64))
                    wanted = max(0, prefix_length(len(found)) - len(first)) if len(found) else 0
                    row = (len(found), digest_of(found), first, others[:wanted])
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                names = [f.split()[0] for f in SIGNATURE.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays], names=names)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(sign, SIGNATURE)


def classes_of(signed: DataFrame) -> DataFrame:
    """cid, rep (least doc_id), digest and set columns of each distinct non-empty set."""
    named = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    rows = named.agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_ngrams", "first", "rest")])
    # stored at once, so that the numbers stay as they are
    return stored(rows.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")


def _needed(n: Column) -> Column:
    return F.floor(n * (100 - LIMIT_PERCENT) / 100).cast("long") + 1


def remaining(classes: DataFrame) -> DataFrame:
    """The classes with fewer n-grams of their own than a prefix takes."""
    grams = classes.select("cid", F.explode("first").alias("h"))
    held = grams.groupBy("h").agg(F.count("*").alias("df"), F.min("cid").alias("cid"))
    own = held.where("df = 1").groupBy("cid").agg(F.count("*").alias("own"))
    left = classes.join(own, "cid", "left").where(F.coalesce("own", F.lit(0)) < _needed(F.col("n_ngrams")))
    return stored(left.drop("own"), "ngram-remaining")


def prefixes(left: DataFrame) -> DataFrame:
    """cid, rep, digest, n_ngrams and the prefix: n-grams h with count df and position, in order.

    N-grams that no other class has take positions but are left out of the prefix.
    """
    grams = left.select("cid", F.explode("first").alias("h"))
    counts = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    listed = F.sort_array(F.collect_list(F.struct("df", "h")))  # no longer than the class's own set
    shared = grams.join(counts, "h").groupBy("cid").agg(listed.alias("shared"))
    rows = left.join(shared, "cid", "left")
    n_shared = F.coalesce(F.size("shared"), F.lit(0))
    own = F.size("first") - n_shared
    rows = rows.withColumn("own", own.cast("long"))
    room = F.greatest(_needed(F.col("n_ngrams")) - F.col("own"), F.lit(0)).cast("int")
    taken = F.slice(F.coalesce("shared", F.array().cast("array<struct<df:bigint,h:bigint>>")), 1, room)

    def entry(df: Column, h: Column, place: Column) -> Column:
        return F.struct(df.alias("df"), h.alias("h"), place.cast("long").alias("place"))

    ranked = F.transform(taken, lambda g, i: entry(g.df, g.h, F.col("own") + i))
    others = F.transform("rest", lambda h, i: entry(F.lit(_LAST), h, F.size("first") + i))
    rows = rows.select("cid", "rep", "digest", "n_ngrams", F.concat(ranked, others).alias("prefix"))
    return stored(rows.where(F.size("prefix") > 0), "ngram-prefixes")


def candidate_ties(prefixed: DataFrame) -> DataFrame:
    """(a, b): classes tied to the least of each bucket of one prefix n-gram and length band.

    Lengths of partners differ by a factor of 10 / 9 at most, so they share one of the two bands
    that each enters.  Buckets are pre-aggregated by salt, and each member is tied to the least of
    its salted bucket, that one to the least of all.
    """
    band = F.floor(F.log(F.col("n_ngrams").cast("double")) / F.log(F.lit(100 / LIMIT_PERCENT)))
    grams = prefixed.select("cid", band.alias("b"), F.explode("prefix.h").alias("h"))
    grams = grams.select("cid", "h", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("band"))
    grams = grams.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    salted = grams.groupBy("h", "band", "salt").agg(F.min("cid").alias("near"), F.max("cid").alias("most"))
    tops = salted.groupBy("h", "band").agg(F.min("near").alias("least"), F.max("most").alias("most")).where("least < most")
    salted = salted.select("h", "band", "salt", "near").join(tops.select("h", "band", "least"), ["h", "band"])
    inner = grams.join(salted, ["h", "band", "salt"]).select(F.col("near").alias("a"), F.col("cid").alias("b"))
    outer = salted.select(F.col("least").alias("a"), F.col("near").alias("b"))
    return inner.union(outer).where("a < b").distinct()


def _dealt(prefixed: DataFrame, groups: DataFrame) -> DataFrame:
    """Classes with a possible partner: their group, block, and the group's number of blocks."""
    placed = prefixed.join(groups.withColumnRenamed("node", "cid"), "cid")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_ngrams") / BLOCK_NGRAMS))
    sizes = placed.groupBy("component").agg(blocks.cast("long").alias("blocks"))
    return placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))


MEMBER = "component long, block long, blocks long, cid long, dfs array<long>, hs array<long>, places array<long>, ngrams binary"


def _with_sets(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The members with their full sets, built anew from the text of the least doc_id, each once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in batches_of(texts):
                part = batch.slice(a, b - a)
                sets = list(ngram_sets(part.column("text")))
                same = pa.array([digest_of(s) == d for s, d in zip(sets, part.column("digest").to_pylist())], pa.bool_())
                sets = pa.array([s.tobytes() for s in sets], pa.binary())
                part = part.drop_columns(["text", "digest"]).append_column("ngrams", sets)
                yield part.filter(same)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text)
    rows = texts.join(placed, "rep").select(
        "component", "block", "blocks", "cid", F.col("prefix.df").alias("dfs"), F.col("prefix.h").alias("hs"),
        F.col("prefix.place").alias("places"), "digest", "text",
    )
    return rows.mapInArrow(gather, MEMBER).dropDuplicates(["cid"])


class _Members:
    """The sets of one block: sizes, prefix entries and the counts of the suffix filter."""

    def __init__(self, rows: pd.DataFrame):
        self.cid = rows["cid"].to_numpy(np.int64)
        self.sets = [np.frombuffer(v, np.uint64) for v in rows["ngrams"]]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        counts = [len(v) for v in rows["hs"]]
        self.row = np.repeat(np.arange(len(rows)), counts)
        self.df, self.h, self.place = (np.concatenate([*rows[c], np.empty(0, np.int64)]) for c in ("dfs", "hs", "places"))
        quarter = [is_first(s) for s in self.sets]
        suffix = [np.bincount((s[~q] >> np.uint64(60)).astype(np.int64), minlength=SLICES) for s, q in zip(self.sets, quarter)]
        self.slices = np.column_stack([np.array(suffix), [q.sum() for q in quarter]])

    def by_ngram(self) -> dict[tuple[int, int], np.ndarray]:
        """Prefix entries by (count, n-gram), which sorts in the common order."""
        order = np.lexsort((self.h, self.df))
        edges = np.flatnonzero(np.diff(self.h[order])) + 1
        parts = np.split(order, edges) if len(order) else []
        return {(int(self.df[p[0]]), int(self.h[p[0]])): p for p in parts}


def candidates(a: _Members, b: _Members, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pass the prefix, length, positional and suffix filters, each once."""
    least = -(-LIMIT_PERCENT * (a.n[:, None] + b.n[None, :]) // (100 + LIMIT_PERCENT))
    met = np.zeros(least.shape, bool)
    passed = np.zeros(least.shape, bool)
    if same:
        met[np.tril_indices(len(a.n))] = True
    of_a, of_b = a.by_ngram(), b.by_ngram()
    for ngram in sorted(of_a.keys() & of_b.keys()):
        x, y = of_a[ngram], of_b[ngram]
        cells = np.ix_(a.row[x], b.row[y])
        behind = np.minimum((a.n[a.row[x]] - a.place[x])[:, None], (b.n[b.row[y]] - b.place[y])[None, :])
        passed[cells] |= ~met[cells] & (behind >= least[cells])
        met[cells] = True
    i, j = np.nonzero(passed)
    apart = np.abs(a.slices[i] - b.slices[j]).sum(axis=1)
    near = apart <= a.n[i] + b.n[j] - 2 * least[i, j]
    return i[near], j[near]


def overlaps(a: _Members, b: _Members, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' full sets."""
    if len(i) <= FEW_PAIRS:
        return np.array([len(np.intersect1d(a.sets[x], b.sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    rows, columns = np.unique(i), np.unique(j)
    left, right = [a.sets[r] for r in rows], [b.sets[c] for c in columns]
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        present = []
        for sets in (left, right):
            table_ = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, own)
                table_[k, place[part[place] == own]] = 1
            present.append(table_)
        both += present[0] @ present[1].T
    return both[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) rows that connect what the links a - b connect."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    return [(top(x), x) for x in above if top(x) != x]


def links(members: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
    """The forest of one unit, a pair of blocks or a block with itself."""
    a = _Members(members[members["block"] == low])
    b = a if low == high else _Members(members[members["block"] == high])
    found = []
    if len(a.n) and len(b.n):
        i, j = candidates(a, b, low == high)
        both = overlaps(a, b, i, j)
        linked = 100 * both >= LIMIT_PERCENT * (a.n[i] + b.n[j] - both)
        found = _forest(a.cid[i[linked]], b.cid[j[linked]])
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def confirmed_links(docs: DataFrame, prefixed: DataFrame) -> DataFrame:
    """Forest edges (a, b) between classes whose full sets reach the limit."""
    groups = components(candidate_ties(prefixed), "ngram-groups")
    members = _with_sets(docs, _dealt(prefixed, groups))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return units.drop("blocks", "other").groupBy("component", "low", "high").applyInPandas(
        lambda key, rows: links(rows, key[1], key[2]), "a long, b long"
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_ngrams, component_id: one row per row of ``docs``.

    Null, empty and blank texts have an empty set and are linked with nothing.  Repeated rows count
    as one document; different texts of one doc_id are classes of their own.  Rows with a null
    doc_id link nothing and get a null component.  Other columns are ignored, an empty table gives
    an empty result.
    """
    signed = stored(signatures(docs), "ngram-signatures")
    classes = classes_of(signed)
    prefixed = prefixes(remaining(classes))
    found = stored(confirmed_links(docs, prefixed), "ngram-links")
    named = components(found, "ngram-components")
    reps = classes.select("cid", "rep", "digest")
    linked = reps.join(named.withColumnRenamed("node", "cid"), "cid")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    linked = linked.join(names, "component").select("cid", "name")
    by_digest = reps.join(linked, "cid", "left").select("digest", F.coalesce("name", "rep").alias("name"))
    rows = signed.select("doc_id", "n_ngrams", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return rows.select("doc_id", "n_ngrams", component.alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("n_ngrams", "n_shingles")


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(3, len(w)) AS m FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
