"""Learned quality rules: a decision list of threshold conjunctions, grown and pruned one by one.

Sequential covering: while labelled bad documents are uncovered, a rule is grown on two thirds
of the labelled rows by adding the threshold with the best gain in information, then cut
back on the other third to the prefix that separates best.  A rule that is not precise
enough there ends the list; otherwise its rows leave the table and the next one is grown.
Each step is one aggregate over binned statistics, so only counts per (statistic, bin)
reach the driver.  The list becomes an ordered ``CASE WHEN`` over the statistics.

``labelled_rows`` bounds the labelled rows that the fit reads (chosen by a hash of doc_id);
the statistics and the list apply to every whole text.  Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, space_words, stored, table, whole_row

LABELLED_ROWS = 20_000
BINS = 32
MOST_CONDITIONS, MOST_RULES = 4, 12
LEAST_PRECISION, LEAST_ROWS = 0.95, 5
SYMBOLS = "#*$%&|<>"
#: fixed values of the base rules
BASE_LEAST_WORDS, BASE_MOST_REPEATED_PERCENT = 50, 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeated_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "duplicate_lines_share": "n_dup_lines / n_lines",
    "mean_word_length": "word_chars / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "digit_share": "n_digits / word_chars",
    "words_per_line": "n_words / n_lines",
}


def _repeated(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows are sorted by hash with their position; equal neighbours repeat.  Sorted
    positions then cover three words each, less what the next one covers again.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))

    def places(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    return let(let(F.sort_array(windows), places), covered)


def _lines(text: Column) -> Column:
    """(n_lines, n_dup_lines): lines with a word, and those equal to an earlier one."""
    full = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc (all columns of ``docs``), doc_id and the statistics of every row's whole text.

    The statistics come out of a generator, so that later filters and columns read them
    instead of evaluating them again.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    counts = F.struct(
        let(space_words(text), of_words).alias("w"),
        _lines(text).alias("l"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        _without(text, upper).cast("long").alias("n_upper"),
        _without(text, digits).cast("long").alias("n_digits"),
        _without(text, "!?;:()[]{}\"=~^").cast("long").alias("n_marks"),
    )
    rows = docs.select(whole_row(docs).alias("doc"), F.explode(F.array(counts)).alias("s"))
    return rows.select(
        "doc",
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        F.col("s.w.n_words").alias("n_words"),
        F.col("s.w.n_repeat_words").alias("n_repeat_words"),
        F.col("s.w.n_distinct").alias("n_distinct"),
        F.col("s.l.n").cast("long").alias("n_lines"),
        F.col("s.l.dup").cast("long").alias("n_dup_lines"),
        *[F.col(f"s.{c}").alias(c) for c in ("word_chars", "n_symbols", "n_upper", "n_digits", "n_marks")],
    )


def base_failed() -> Column:
    return (F.col("n_words") < BASE_LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MOST_REPEATED_PERCENT * F.col("n_words")
    )


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    limit: float

    def sql(self) -> str:
        return f"coalesce({MEASURES[self.measure]}, 0) {'>' if self.above else '<='} {self.limit!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects a document, and none keeps it."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """The number of the first rule that holds, 0 if none does."""
        if not self.rules:
            return F.lit(0)
        cases = " ".join(
            f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(self.rules, 1)
        )
        return F.expr(f"CASE {cases} ELSE 0 END")


def _labelled(docs: DataFrame, labels: DataFrame, labelled_rows: int) -> DataFrame:
    """Measures, bad and part (grow or prune) of at most about ``labelled_rows`` labelled documents."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("key"), "quality")
    share = min(1.0, labelled_rows / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    drawn = drawn.groupBy("key").agg(F.min("quality").alias("quality"))
    # bounded by labelled_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    chosen = texts.join(F.broadcast(drawn), "key").select(F.col("key").alias("doc_id"), "text", "quality")
    rows = statistics(chosen)
    return rows.select(
        (F.col("doc.quality") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) > 0).alias("grow"),
        *[F.expr(f"coalesce(try_divide({e.split(' / ')[0]}, {e.split(' / ')[1]}), 0)").alias(n) for n, e in MEASURES.items()],
    )


def _bins(rows: DataFrame) -> dict[str, list[float]]:
    """Per measure, limits between bins: quantiles of either class."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(m, shares, 2000).alias(m) for m in MEASURES]).collect()
    return {m: sorted({float(x) for r in found for x in r[m] or ()}) for m in MEASURES}


def _bin(measure: str, limits: list[float]) -> Column:
    """How many of the sorted limits the measure exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(measure))) if limits else F.lit(0)


def _counts(rows: DataFrame, limits: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per measure and bin, (bad, good) of the growing rows."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"bin_{m}").alias("b")) for m in MEASURES])
    )
    found = (
        rows.where("grow").select("bad", cells.alias("c")).groupBy("c.m", "c.b")
        .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    )
    out = {m: [(0, 0)] * (len(limits[m]) + 1) for m in MEASURES}
    for r in found:
        out[r.m][r.b] = (r.p, r.n)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on the bad rows that stay covered."""
    return 0.0 if not p else p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best(counts: dict, limits: dict) -> tuple[float, Condition | None]:
    best: tuple[float, Condition | None] = (0.0, None)
    for m in MEASURES:
        p0, n0 = (sum(x[i] for x in counts[m]) for i in (0, 1))
        p = n = 0
        for limit, (a, b) in zip(limits[m], counts[m]):
            p, n = p + a, n + b
            for above, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                if gain > best[0] + 1e-9:
                    best = gain, Condition(m, above, limit)
    return best


def _holds(rule: tuple[Condition, ...]) -> Column:
    holds = F.lit(True)
    for c in rule:
        holds = holds & (F.col(c.measure) > c.limit if c.above else F.col(c.measure) <= c.limit)
    return holds


def learn(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DecisionList:
    """The decision list; empty if no labelled document is bad."""
    rows = stored(_labelled(docs, labels, labelled_rows), "rules-labelled")
    limits = _bins(rows)
    bins = {f"bin_{m}": _bin(m, limits[m]) for m in MEASURES}
    rows = stored(rows.withColumns(bins), "rules-binned")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES:
        rule: tuple[Condition, ...] = ()
        while len(rule) < MOST_CONDITIONS:
            counts = _counts(rows.where(_holds(rule)), limits)
            p, n = (sum(x[i] for x in counts["mean_word_length"]) for i in (0, 1))
            gain, condition = _best(counts, limits) if p and n else (0.0, None)
            if condition is None:
                break
            rule += (condition,)
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        if not prefixes:
            break
        tallies = rows.where("NOT grow").agg(
            *[F.count_if(F.col("bad") & _holds(r)).alias(f"p{k}") for k, r in enumerate(prefixes)],
            *[F.count_if(~F.col("bad") & _holds(r)).alias(f"n{k}") for k, r in enumerate(prefixes)],
        ).first()
        worth = [(tallies[f"p{k}"] - tallies[f"n{k}"]) / max(1, tallies[f"p{k}"] + tallies[f"n{k}"]) for k in range(len(prefixes))]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        p, n = tallies[f"p{k}"], tallies[f"n{k}"]
        if p + n < LEAST_ROWS or p < LEAST_PRECISION * (p + n):
            break
        rules.append(prefixes[k])
        rows = rows.where(~_holds(prefixes[k]))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc, doc_id, the statistics, base_failed, rule (number, 0: none) and kept of every row."""
    rows = statistics(docs).withColumn("base_failed", base_failed())
    # words exist wherever the list is asked, so no ratio divides by zero
    rule = F.when(F.col("base_failed"), F.lit(0)).otherwise(rules.column())
    return rows.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The judged rows of ``docs``.

    Null and empty texts have no words and fail the base rules.  A null doc_id is judged like any
    other; repeated rows are judged each; columns of ``docs`` stay inside ``doc``, whatever
    their names; an empty table gives an empty result and labels without bad rows an empty list.
    """
    return judge(docs, learn(docs, labels, labelled_rows))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *BASE, "base_failed", "kept", "rule")
