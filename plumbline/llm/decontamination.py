"""Benchmark decontamination by winnowing.

Both sides keep the least 5-word hash of every window of ten words (an item shorter than
that is one window, with the least hash of its own length).  Two equal windows keep the same
hash, so joining these fingerprints finds every shared span of a window or more, while a text
keeps only about two hashes in seven.  Matched fingerprints are then extended: the windows
around them are compared as a whole (two 64-bit hashes), and the words they cover are hit.

Texts are split once to count words and find fingerprints, again only if they matched, and
never shuffled unless they matched.  The benchmark's fingerprints are
broadcast up to ``BROADCAST_ROWS`` of them, joined by a shuffle beyond.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, letter_words, stored, table

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 500_000
#: repeated rows are written out in steps of so many
STEP = 4096


def words_of(text: Column) -> Column:
    return letter_words(text.cast("string"))


def _starts(words: Column, length: int) -> Column:
    """Positions at which ``length`` words begin."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>")
    )


def _grams(words: Column, size: int) -> Column:
    return F.transform(_starts(words, size), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))


def _least(grams: Column, span: int) -> Column:
    """The least of each ``span`` consecutive hashes."""
    if span == 1:
        return grams
    return F.transform(_starts(grams, span), lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))


def _window_prints(words: Column, m: int) -> Column:
    """The fingerprint of the window of ``m`` words at each position."""
    size = min(m, GRAM)
    return let(_grams(words, size), lambda grams: _least(grams, m - size + 1))


def _windows(words: Column, prints: Column, m: int, wanted: Column | None = None) -> Column:
    """array of (start, length, print, a, b): the windows, of the wanted fingerprints only."""

    def window(i: Column) -> Column:
        part = F.slice(words, i + 1, F.lit(m))
        return F.struct(
            i.cast("int").alias("start"), F.lit(m).alias("m"), F.get(prints, i).alias("print"),
            F.xxhash64(part).alias("a"), F.xxhash64(F.lit(m), part).alias("b"),
        )

    starts = _starts(words, m)
    if wanted is not None:
        starts = F.filter(starts, lambda i: F.array_contains(wanted, F.get(prints, i)))
    return F.transform(starts, window)


def _all_windows(words: Column, lengths: list[int], wanted: Column | None = None) -> Column:
    parts = [let(_window_prints(words, m), lambda p: _windows(words, p, m, wanted)) for m in lengths]
    return F.concat(*parts)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (text), m, print, a, b of every window of every item; items without words have none."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    items = items.select("item_id", F.explode(F.array("w")).alias("w")).where(F.size("w") > 0)
    by_length = F.lit(None)
    for m in range(1, WINDOW + 1):
        fits = F.size("w") == m if m < WINDOW else F.size("w") >= WINDOW
        by_length = F.when(fits, let(F.col("w"), lambda w: _all_windows(w, [m]))).otherwise(by_length)
    return items.select("item_id", F.inline(by_length)).drop("start").distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, as counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.tk == b.tk)


def _each(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, in steps that keep the lists short."""
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(STEP).cast("long"))))
    rest = F.least(F.lit(STEP), F.col(times) - F.col("step"))
    return df.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), rest))).drop("step")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; so is everything if no item has words.
    Items without item_id are left out, repeated items count once.  Repeated documents are
    judged each, also with a null doc_id; other columns are ignored.
    """
    windows = stored(item_windows(benchmark), "winnow-items")
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # ten at most
    rows = _keyed(docs)
    none = F.sha2(F.lit(""), 256)
    if not lengths:
        counted = rows.select("doc_id", "tk", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        return counted.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))

    def prints_and_size(words: Column) -> Column:
        """A row per distinct fingerprint, and one with the number of words."""
        prints = F.array_distinct(F.concat(*[_window_prints(words, m) for m in lengths]))
        no_size = F.lit(None).cast("int")
        # the row of the size gets a hash as its key, so that a shuffle join spreads it
        size = F.struct(F.xxhash64("doc_id", "tk").alias("print"), F.size(words).alias("size"))
        return F.concat(F.transform(prints, lambda p: F.struct(p.alias("print"), no_size.alias("size"))), F.array(size))

    # texts are split once for both: their numbers of words and the fingerprints that items share
    marks = rows.select("doc_id", "tk", F.inline(let(words_of(F.col("text")), prints_and_size)))
    wanted = _small(windows.select("print").distinct().withColumn("shared", F.lit(True)))
    marks = marks.join(wanted, "print", "left").where("shared OR size IS NOT NULL")
    judged = marks.groupBy("doc_id", "tk").agg(
        F.max("size").cast("long").alias("n_words"),
        F.count("size").alias("copies"),
        F.collect_set(F.when(F.col("size").isNull(), F.col("print"))).alias("wanted"),
    )
    judged = stored(judged, "winnow-judged")
    matched = stored(judged.where(F.size("wanted") > 0).select("doc_id", "tk", "wanted"), "winnow-matched")

    # windows that the same items hold are one set, so a passage of many items stays one row
    sets = windows.groupBy("m", "print", "a", "b").agg(
        F.sum(F.xxhash64("item_id").cast("decimal(20,0)")).alias("set_a"), F.count("*").alias("set_b")
    )
    members = windows.join(sets, ["m", "print", "a", "b"]).select("set_a", "set_b", "item_id").distinct()
    # the keys of matched rows alone go to the scan, so that other texts aren't shuffled
    named = _small(matched.select("doc_id", "tk"))
    rows = rows.join(named, _same_row(rows, named), "left_semi")
    found = rows.join(matched, _same_row(rows, matched)).select(rows.doc_id, rows.tk, "text", "wanted")
    spans = found.select(
        "doc_id", "tk", F.inline(let(words_of(F.col("text")), lambda w: _all_windows(w, lengths, F.col("wanted"))))
    )
    hits = spans.join(_small(sets), ["m", "print", "a", "b"]).select("doc_id", "tk", "start", "m", "set_a", "set_b")
    hits = stored(hits.distinct(), "winnow-hits")

    def covered(ordered: Column) -> Column:
        step = lambda s, x: F.struct(
            F.greatest(s["until"], x["start"] + x["m"]).alias("until"),
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(s["until"], x["start"]))).alias("n"),
        )
        return F.aggregate(ordered, F.struct(F.lit(0).alias("until"), F.lit(0).alias("n")), step)["n"]

    # documents with the same sets of items share one list, built once however many they are
    sets_held = F.sort_array(F.collect_set(F.struct("set_a", "set_b")))
    starts_held = F.sort_array(F.collect_set(F.struct("start", "m")))
    words = hits.groupBy("doc_id", "tk").agg(covered(starts_held).cast("long").alias("n_hit"), sets_held.alias("held"))
    words = words.withColumns({"held_a": F.xxhash64("held"), "held_b": F.xxhash64(F.lit(1), "held")})
    words = stored(words, "winnow-words")
    lists = words.groupBy("held_a", "held_b").agg(F.first("held").alias("held"))
    lists = lists.select("held_a", "held_b", F.inline("held")).join(members, ["set_a", "set_b"])
    lists = lists.groupBy("held_a", "held_b").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    lists = lists.select(
        "held_a", "held_b", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    )
    both = words.drop("held").join(lists, ["held_a", "held_b"]).drop("held_a", "held_b")
    both = both.withColumnsRenamed({"doc_id": "d", "tk": "t"})
    joined = judged.join(both, judged.doc_id.eqNullSafe(both.d) & (judged.tk == both.t), "left")
    return _each(joined.drop("wanted"), "copies").select(
        "doc_id", "tk", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tk")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, s, item_id FROM dw JOIN iw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
