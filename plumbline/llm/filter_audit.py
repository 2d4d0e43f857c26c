"""Interaction of text filters: what each removes at every step of every order of application.

1. One pass over the texts gives every row the set of filters that it fails, as a bit mask.  The
   duplicate filter compares 128-bit digests of whole texts table-wide; both its groups and the
   labels meet in mergeable aggregates and joins of short rows, never in lists.
2. Rows are counted by part and mask: at most 32 cells a part, whatever the table's size.
3. Per part a Gray-code walk visits all 32 subsets of filters by toggling one at a time.  Each cell
   keeps the number of active filters that it fails, and the running survivors change only by the
   cells whose number leaves or reaches zero.  The survivors of each subset are stored.
4. Every step of every order is a difference of two stored states.

The filters: A too few words, B too few distinct words, C too many capitals, D holds a symbol,
E identical to the text of a smaller doc_id.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, stored, table

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "#$%&*|"
COUNTS = ("n", "good", "toxic")

_CAPITALS, _SYMBOLS = UPPER.encode(), SYMBOLS.encode()
_CONTINUED = bytes(range(0x80, 0xC0))
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failed_mask(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, A in the lowest bit.

    ``bytes.split`` parts words at ASCII white space only, as the definition of a word asks.
    """
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * capitals > CAPITAL_PERCENT * points,
        len(text.translate(None, _SYMBOLS)) < len(text),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, h1, h2, mask: filters A to D of each row, and a digest of its text."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([failed_mask(t.as_py()) for t in batch.column("mask")], pa.int32())
            yield batch.set_column(batch.schema.get_field_index("mask"), "mask", masks)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),  # another seed
        text.cast("binary").alias("mask"),
    )
    return rows.mapInArrow(judge, "doc_id long, part string, h1 long, h2 long, mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: rows by part and failed filters, E included.

    A row fails E if its text occurs under a smaller doc_id.  Rows are first counted by text and
    doc_id, so that a text which fills a third of the table is one short row per id and task, then
    by text and cell: of a text's rows, those with its least doc_id pass and the rest fail.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("long").alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("long").alias("toxic"),
    )
    rows = failures(docs).groupBy("doc_id", "part", "h1", "h2", "mask").agg(F.count("*").alias("n"))
    rows = stored(rows, "audit-rows")  # read twice below; the texts once
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    shape = ["h1", "h2", "part", "mask", "good", "toxic"]
    # of a cell's rows of one text only those of its least doc_id can pass
    grouped = rows.groupBy(*shape).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min("doc_id").alias("least"),
        F.min_by("n", first).alias("at_least"),
    )
    texts = grouped.groupBy("h1", "h2").agg(F.min("least").alias("first_id"))
    grouped = grouped.join(texts, ["h1", "h2"])
    passing = F.col("nameless") + F.when(F.col("least") == F.col("first_id"), F.col("at_least")).otherwise(0)
    split = F.inline(
        F.array(
            F.struct(F.col("mask").alias("cell"), passing.alias("rows")),
            F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("cell"), (F.col("n") - passing).alias("rows")),
        )
    )
    split = grouped.select("part", "good", "toxic", split).where("rows > 0")
    return split.groupBy("part", F.col("cell").alias("mask")).agg(
        F.sum("rows").alias("n"),
        F.sum(F.col("rows") * F.col("good")).alias("good"),
        F.sum(F.col("rows") * F.col("toxic")).alias("toxic"),
    )


def walked(masks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Survivors (rows: subsets of filters, columns: as ``counts``) by a Gray-code walk."""
    states = np.zeros((1 << len(FILTERS), counts.shape[1]), np.int64)
    active = np.zeros(len(masks), np.int64)
    survivors = counts.sum(axis=0)
    states[0] = survivors
    before = 0
    for step in range(1, len(states)):
        subset = step ^ (step >> 1)
        toggled = subset ^ before
        hit = (masks & toggled) > 0
        if subset & toggled:
            survivors = survivors - counts[hit & (active == 0)].sum(axis=0)
            active[hit] += 1
        else:
            active[hit] -= 1
            survivors = survivors + counts[hit & (active == 0)].sum(axis=0)
        states[subset] = survivors
        before = subset
    return states


def orders(part: str, masks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """The rows of one part: every order and step from differences of stored states."""
    states = walked(masks, counts)
    fails = [int(counts[(masks >> f) & 1 == 1, 0].sum()) for f in range(len(FILTERS))]
    only = [int(counts[masks == 1 << f, 0].sum()) for f in range(len(FILTERS))]
    rows, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        name, subset = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            removed, good, toxic = (int(v) for v in states[subset] - states[subset | 1 << f])
            subset |= 1 << f
            shapley[f] += removed
            rows.append([part, name, step, int(states[subset, 0]), removed, fails[f] - removed, only[f], good, toxic])
    return pd.DataFrame([[*row, shapley[FILTERS.index(row[1][row[2] - 1])]] for row in rows])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (value of lang), order of the five filters and step.

    Null texts are empty texts, null langs the part ''.  Rows of one doc_id and text count each and
    don't remove each other; rows without doc_id are never later than others.  A doc_id with several
    labels is good or toxic if one of them says so.  An empty table has no parts; other columns are
    ignored.
    """

    def audit(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        counts = held[list(COUNTS)].to_numpy(np.int64)
        out = orders(key[0], held["mask"].to_numpy(np.int64), counts)
        out.columns = [c.split()[0] for c in RESULT.split(", ")]
        return out

    return cells(docs, labels).groupBy("part").applyInPandas(audit, RESULT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM t JOIN least_id USING (text) LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
p AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) AS upto FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & CAST(upto AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & CAST(upto AS BIGINT) = bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & CAST(upto AS BIGINT) <> bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & CAST(upto AS BIGINT) = bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & CAST(upto AS BIGINT) = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""
