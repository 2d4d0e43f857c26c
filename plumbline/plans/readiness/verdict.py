"""From measured figures to a verdict: essential criteria, points, messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.functions.rules import first_match, matching_codes
from plumbline.operators.local import local_table
from plumbline.plans.labels import FIT_COLORS
from plumbline.plans.texts import with_texts

# Total points needed for each verdict.
FIT = [("NOT passed", "unfit"), ("score >= 80", "fit"), ("score >= 60", "partly")]


@dataclass(frozen=True)
class Criterion:
    """A scored criterion: SQL conditions with points, first match wins, else ``default``."""

    code: str
    max_score: int
    rules: Sequence[tuple[str, int]]
    default: int = 0


@dataclass(frozen=True)
class Rulebook:
    """Everything that is fixed about one analysis purpose.

    Conditions are SQL over the measured figures.  ``essential`` must all hold; their
    outcome is available as ``passed`` in the message and note conditions.
    """

    name: str
    essential: Sequence[tuple[str, str]]
    points: Sequence[Criterion]
    messages: Sequence[tuple[str, str]] = ()
    notes: Sequence[tuple[str, str]] = ()
    summary: Sequence[str] = ()


@dataclass(frozen=True)
class Readiness:
    """Verdict tables of one analysis purpose."""

    purpose: str
    result: DataFrame
    essential: DataFrame
    score_detail: DataFrame
    summary: DataFrame
    messages: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)

    def with_details(self, **tables: DataFrame) -> "Readiness":
        return replace(self, details={**self.details, **tables})

    def recommendations(self) -> DataFrame:
        """Messages and notes, each code once, in order."""
        return (
            self.messages.groupBy("code").agg(F.min("message_no").alias("message_no")).orderBy("message_no").select("code")
        )

    def tables(self) -> dict[str, DataFrame]:
        """Every part by name, as ``write_report`` takes them."""
        parts = {
            "result": self.result,
            "essential": self.essential,
            "score_detail": self.score_detail,
            "summary": self.summary,
            "messages": with_texts(self.messages),
        }
        return parts | {f"detail_{name}": table for name, table in self.details.items()}

    def sheet(self) -> DataFrame:
        """All parts in one table: (section, item, value)."""
        number = F.lit(1.0)
        parts = [
            self.essential.select(
                F.lit("essential").alias("section"),
                F.col("criterion").alias("item"),
                F.col("passed").cast("int").cast("double").alias("value"),
            ),
            self.score_detail.select(
                F.lit("points").alias("section"),
                F.col("criterion").alias("item"),
                F.col("score").cast("double").alias("value"),
            ),
            self.summary.select(
                F.lit("summary").alias("section"), "item", V.rounded(F.col("value"), 4).alias("value")
            ),
            self.messages.select(
                F.col("kind").alias("section"), F.col("code").alias("item"), number.alias("value")
            ),
            self.result.select(
                F.lit("status").alias("section"),
                F.col("status").alias("item"),
                V.rounded(F.col("score"), 4).alias("value"),
            ),
        ]
        return reduce(DataFrame.unionByName, parts)


def _sql_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, str):
        return "string"
    return "double"


def _figures(spark: SparkSession, figures: Mapping[str, object]) -> DataFrame:
    schema = ", ".join(f"{name} {_sql_type(v)}" for name, v in figures.items())
    return local_table(spark, [tuple(figures.values())], schema)


def judge(spark: SparkSession, book: Rulebook, figures: Mapping[str, object]) -> Readiness:
    """Apply a rulebook to one row of measured figures."""
    met = [F.coalesce(F.expr(condition), F.lit(False)) for _, condition in book.essential]
    passed = reduce(lambda a, b: a & b, met, F.lit(True))
    row = _figures(spark, figures).withColumn("passed", passed)

    tests: list[Column] = []
    for code, condition in book.essential:
        tests += [F.lit(code), F.expr(condition)]
    essential = row.select(
        F.stack(F.lit(len(book.essential)), *tests).alias("criterion", "passed")
    )

    cells: list[Column] = []
    for c in book.points:
        cells += [
            F.lit(c.code),
            first_match(c.rules, c.default).cast("int"),
            F.lit(c.max_score),
            first_match([(condition, condition) for condition, _ in c.rules], "otherwise"),
        ]
    score_detail = row.where("passed").select(
        F.stack(F.lit(len(book.points)), *cells).alias("criterion", "score", "max_score", "reason")
    )

    total = reduce(lambda a, b: a + b, [first_match(c.rules, c.default) for c in book.points])
    result = (
        row.select("passed", F.when(F.col("passed"), total).otherwise(F.lit(0)).cast("double").alias("score"))
        .withColumn("status", first_match(FIT, "unfit"))
        .select(
            F.lit(book.name).alias("purpose"),
            "status",
            first_match([(f"status = '{s}'", c) for s, c in FIT_COLORS.items()], "secondary").alias("color"),
            "score",
        )
    )

    shown: list[Column] = []
    for name in book.summary:
        shown += [F.lit(name), F.col(name).cast("double")]
    summary = row.select(F.stack(F.lit(len(book.summary)), *shown).alias("item", "value"))

    said = [("message", book.messages, 0), ("note", book.notes, 1000)]
    messages = reduce(
        DataFrame.unionByName,
        [
            row.select(F.posexplode(matching_codes(rules)).alias("n", "code")).select(
                (F.col("n") + F.lit(offset)).alias("message_no"), F.lit(kind).alias("kind"), "code"
            )
            for kind, rules, offset in said
        ],
    )
    return Readiness(book.name, result, essential, score_detail, summary, messages)
