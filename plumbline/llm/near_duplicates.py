"""Near-duplicates by b-bit MinHash: bands find candidates, low bits estimate, full sets decide.

1. Every text becomes its set of 5-word shingles; equal sets share a digest and count as one
   class.  Of each class the minima of 200 permutations give 40 band keys of five minima and
   2 low bits per minimum, packed in longs.
2. Classes that share a band key are candidates of each other.  Buckets are not expanded:
   every member is tied to the least of its bucket, and the connected groups of these ties
   hold every candidate pair.  A pair at the limit shares no band once in 50,000.
3. Groups are dealt into blocks of bounded size, and each pair of blocks is one unit of work.
   A unit estimates similarity by counting equal low bits (corrected for chance agreement),
   drops what is far below the limit, and compares the full sets of the rest.  It emits a
   spanning forest of its links, at most one row per member, never its pairs.
4. Components of the forests name the classes; rows get them by digest.

A unit is bounded, but a group of N different near copies needs (N / 256)^2 / 2 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components
from .shingles import LOW_BITS, PERMUTATIONS, band_keys, minima, packed_bits, shingle_set

LIMIT_PERCENT = 75
BLOCK_MEMBERS = 256
BLOCK_SHINGLES = 400_000
COLUMNS = 4096
#: The estimate's standard deviation is about 0.037 at the limit; five of them keep every link.
ESTIMATE_MARGIN = 0.19
CHANCE = 1 / (1 << LOW_BITS)

SIGNATURE = "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set, band keys and packed low bits of each row's text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_shingles": [], "digest": [], "keys": [], "bits": []}
            seen: dict[bytes, tuple] = {}
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                if digest not in seen:
                    least = minima(found) if len(found) else None
                    seen[digest] = (None, None) if least is None else (band_keys(least), packed_bits(least))
                keys, bits = seen[digest]
                for name, value in zip(rows, (len(found), digest, keys, bits)):
                    rows[name].append(value)
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(v, t) for v, t in zip(rows.values(), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *rows])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(sign, SIGNATURE)


def candidate_ties(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the least class of every bucket that it shares with others."""
    bands = classes.select(F.explode("keys").alias("key"), "rep")
    buckets = bands.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    buckets = buckets.where("least <> most").select("key", "least")
    ties = bands.join(buckets, "key").where("rep <> least")
    return ties.select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()


def estimate(bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Similarity of all pairs from packed low bits, corrected for chance agreement."""
    apart = bits_a[:, None, :] ^ bits_b[None, :, :]
    apart = (apart | (apart >> np.uint64(1))) & np.uint64(0x5555555555555555)
    equal = PERMUTATIONS - np.bitwise_count(apart).sum(axis=2, dtype=np.int32)
    return (equal / PERMUTATIONS - CHANCE) / (1 - CHANCE)


def _forest(rows: np.ndarray, columns: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, member) over the links between positions; roots are the least nodes."""
    above = list(range(len(nodes)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for i, j in zip(rows.tolist(), columns.tolist()):
        i, j = top(i), top(j)
        if i != j:
            i, j = (i, j) if nodes[i] <= nodes[j] else (j, i)
            above[j] = i
    for i in range(len(nodes)):
        if top(i) != i:
            yield int(nodes[top(i)]), int(nodes[i])


def links(members: pd.DataFrame) -> pd.DataFrame:
    """The forest of one unit: columns rep, bits (longs), shingles (bytes of sorted uint64)."""
    members = members.sort_values("rep", kind="stable")
    nodes = members["rep"].to_numpy()
    bits = np.stack(members["bits"].to_numpy()).astype(np.int64).view(np.uint64)
    limit = LIMIT_PERCENT / 100 - ESTIMATE_MARGIN
    near = np.zeros((len(nodes), len(nodes)), bool)
    for i in range(0, len(nodes), 64):
        near[i : i + 64] = estimate(bits[i : i + 64], bits) >= limit
    np.fill_diagonal(near, False)
    kept = np.flatnonzero(near.any(axis=1))
    if not len(kept):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sets = [np.frombuffer(members["shingles"].iloc[i], np.uint64) for i in kept]
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(kept)), sizes), count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(kept), len(kept)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        present = np.zeros((len(kept), COLUMNS), np.float32)
        present[row[a:b], column[a:b] - start] = 1
        both += present @ present.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (100 * both >= LIMIT_PERCENT * union) & near[np.ix_(kept, kept)]
    found = _forest(*np.nonzero(np.triu(linked, 1)), nodes[kept])
    return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Forest edges (a, b) between classes whose full sets reach the limit."""
    placed = classes.join(groups, classes.rep == groups.node).select("rep", "digest", "n_shingles", "bits", "component")
    sizes = groups_of(placed)
    placed = placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    sets = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").cast("binary").alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, bytes]] = set()  # short keys of this task's classes
        for batch in batches:
            keys = list(zip(batch.column("rep").to_pylist(), batch.column("digest").to_pylist()))
            kept, held = [], []
            for i, key in enumerate(keys):
                if key in done:
                    continue
                found = shingle_set(batch.column("text")[i].as_py()).tobytes()
                if xxhash.xxh3_128_digest(found) == key[1]:  # else another text of the same doc_id
                    done.add(key)
                    kept.append(i)
                    held.append(found)
            at = batch.schema.get_field_index("text")
            yield batch.take(pa.array(kept, pa.int64())).set_column(at, "shingles", pa.array(held, pa.binary()))

    near = placed.join(sets, "rep").select("rep", "digest", "component", "block", "blocks", "bits", "text")
    shape = "rep long, digest binary, component long, block long, blocks long, bits array<long>, shingles binary"
    # each class once, however often its row is repeated
    near = near.mapInArrow(gather, shape).dropDuplicates(["rep", "digest"]).drop("digest")
    units = near.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    units = units.select("component", "low", "high", "rep", "bits", "shingles")
    return units.groupBy("component", "low", "high").applyInPandas(
        lambda pdf: links(pdf[["rep", "bits", "shingles"]]), "a long, b long"
    )


def groups_of(placed: DataFrame) -> DataFrame:
    """(component, blocks): how many blocks a group is dealt into, by members and by shingles."""
    return placed.groupBy("component").agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.lit(1)
        ).cast("long").alias("blocks")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Null, empty and blank texts have an empty set and are linked with nothing.  Rows that share
    a doc_id count as one document; rows with a null doc_id get a null component and are kept.
    Other columns are ignored, an empty table gives an empty result.
    """
    signed = stored(signatures(docs), "minhash")
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    classes = classes.agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "keys", "bits")]
    )
    classes = stored(classes, "minhash-classes")
    groups = components(candidate_ties(classes), "minhash-groups")
    found = stored(confirmed_links(docs, classes.drop("keys"), groups), "minhash-links")
    named = components(found, "minhash-components")
    # a class is reached by its digest, and by a doc_id that it shares with another class
    by_digest = classes.join(named, classes.rep == named.node, "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    rows = signed.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(5, len(w)) AS m FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
