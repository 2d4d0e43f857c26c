"""The column profile: everything that depends on the distinct values of a column.

The cells of the table are stacked to (column, value) rows and counted with one
``groupBy(column, value).count()``.  The map side combines equal values first, so a value
that fills a third of the table reaches the shuffle as one row per task, and no task holds
a column.  Numbers, dates and short strings are their own key; longer strings are
represented by a SHA-256 digest, so whole texts are read but never shuffled.  A second
aggregate folds the value counts to one row per column.

Columns are stacked by the shape of their key (whole number, floating point, text): at
most three scans, each reading its own columns of a parquet or ORC file, with narrow
typed shuffle rows.  ``single_pass=True`` stacks all columns in one scan instead, for
CSV/JSON and for inputs that are costly to recompute.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.functions.rules import case_text
from plumbline.operators.clean import Frame, frame_of
from plumbline.operators.local import local_table
from plumbline.operators.scans import COLUMNS_PER_SCAN, columns_per_scan, input_files

SHORT_TEXT = 64
ROW_FORMATS = re.compile(r"\.(csv|tsv|txt|json|jsonl)(\.\w+)?$", re.IGNORECASE)

# Fixed value: token test for identifier-like column names.
ID_NAME = re.compile(r"(^|[^a-z])(id|no|code|key|seq)([^a-z]|$)")

STATS_SCHEMA = (
    "pos int, n_rows bigint, n_missing bigint, n_non_missing bigint, n_unique bigint, "
    "max_count bigint, min_count bigint, n_nan bigint, n_pos_inf bigint, n_neg_inf bigint, "
    "n_number_text bigint, n_date_text bigint, has_date_hint boolean, is_date boolean"
)
TYPES_SCHEMA = (
    "pos int, variable string, physical_type string, kind string, n_rows bigint, "
    "n_missing bigint, n_non_missing bigint, n_unique bigint, unique_ratio double, "
    "max_count bigint, min_count bigint, n_nan bigint, n_pos_inf bigint, n_neg_inf bigint, "
    "n_number_text bigint, n_date_text bigint, has_date_hint boolean, "
    "is_time_candidate boolean, variable_type string"
)


def is_id_like_name(name: str | None) -> bool:
    """Does the name carry id/no/code/key/seq as a token of its own?"""
    return bool(name and name.strip() and ID_NAME.search(name.strip().lower()))


# --- value counts -----------------------------------------------------------


def _text_key(x: str) -> str:
    return f"CASE WHEN length({x}) <= {SHORT_TEXT} THEN {x} ELSE concat('#', sha2({x}, 256)) END"


def _long_text_flags(x: str) -> str:
    """What has to be known of a long text besides its digest.

    Bit 1: a number, bit 2: a date hint somewhere in the text.  The flags follow from
    the text, so adding them to the key changes no group.
    """
    return (
        f"CASE WHEN length({x}) > {SHORT_TEXT} THEN if({V.looks_numeric_with_commas(x)}, 1, 0) "
        f"+ if({V.has_date_hint(x)}, 2, 0) ELSE 0 END"
    )


def _shape(frame: Frame, p: int) -> str:
    dtype, kind = frame.dtypes[p], frame.kinds[p]
    if kind == "nested":
        return "nested"
    if kind == "string" or isinstance(dtype, T.DecimalType):
        return "text"
    return "real" if V.is_floating(dtype) else "whole"


def _whole_key(frame: Frame, p: int) -> str:
    x, kind, dtype = f"c{p}", frame.kinds[p], frame.dtypes[p]
    if kind == "timestamp":
        return V.micros_text(x, dtype)
    if kind == "date":
        return f"CAST(unix_date({x}) AS BIGINT)"
    if kind == "boolean":
        return f"CAST(CAST({x} AS INT) AS BIGINT)"
    return f"CAST({x} AS BIGINT)"


def _stacked_stats(frame: Frame, positions: Sequence[int]) -> DataFrame:
    """Profile rows of the given columns from one scan."""
    shapes = {p: _shape(frame, p) for p in positions}
    used = [s for s in ("whole", "real", "text") if s in shapes.values()]
    keys = used + (["f"] if "text" in used else [])
    empty = {"whole": "BIGINT", "real": "DOUBLE", "text": "STRING"}
    cells: list[str] = []
    for p in positions:
        x, word = f"c{p}", frame.kinds[p] == "string"
        filled = {
            "whole": _whole_key(frame, p) if shapes[p] == "whole" else "",
            "real": f"CAST({x} AS DOUBLE)",
            "text": _text_key(x) if word else f"CAST({x} AS STRING)",
        }
        cells.append(str(p))
        cells += [filled[s] if shapes[p] == s else f"CAST(NULL AS {empty[s]})" for s in used]
        if "text" in used:
            cells.append(_long_text_flags(x) if word else "0")
    stacked = f"stack({len(positions)}, {', '.join(cells)}) AS (pos, {', '.join(keys)})"
    return (
        frame.df.selectExpr(stacked)
        .groupBy("pos", *keys)
        .agg(F.expr("count(1) AS cnt"))
        .groupBy("pos")
        .agg(*[F.expr(f"{body} AS {name}") for name, body in _fold(frame, positions, used).items()])
    )


def _fold(frame: Frame, positions: Sequence[int], used: Sequence[str]) -> dict[str, str]:
    """Aggregates over (pos, value, count) rows that make up one profile row."""

    def members(*kinds: str) -> str:
        chosen = [str(p) for p in positions if frame.kinds[p] in kinds]
        if len(chosen) == len(positions):
            return "true"
        return f"pos IN ({', '.join(chosen)})" if chosen else "false"

    def total(test: str) -> str:
        return f"coalesce(sum(cnt) FILTER (WHERE {test}), 0L)"

    tests = {"whole": "whole IS NOT NULL", "real": "(real IS NOT NULL AND NOT isnan(real))"}
    tests["text"] = "text IS NOT NULL"
    numbers = {"whole": "CAST(whole AS DOUBLE)", "real": "real", "text": "try_cast(text AS DOUBLE)"}
    here = "(" + " OR ".join(tests[s] for s in used) + ")"
    number = numbers[used[0]] if len(used) == 1 else f"coalesce({', '.join(numbers[s] for s in used)})"
    out = {
        "n_rows": "coalesce(sum(cnt), 0L)",
        "n_missing": total(f"NOT {here}"),
        "n_non_missing": total(here),
        "n_unique": f"count(1) FILTER (WHERE {here})",
        "max_count": f"coalesce(max(cnt) FILTER (WHERE {here}), 0L)",
        "min_count": f"coalesce(min(cnt) FILTER (WHERE {here}), 0L)",
        "n_nan": "0L",
        "n_pos_inf": "0L",
        "n_neg_inf": "0L",
        "n_number_text": "0L",
        "n_date_text": "0L",
        "has_date_hint": "false",
    }
    dates = []
    if "real" in used:
        out["n_nan"] = total("isnan(real)")
        out["n_pos_inf"] = total("real = CAST('Infinity' AS DOUBLE)")
        out["n_neg_inf"] = total("real = CAST('-Infinity' AS DOUBLE)")
    if "text" in used:
        words = members("string")
        short = f"{words} AND length(text) <= {SHORT_TEXT}"
        dated = f"({short} AND {V.looks_like_date('text')})"
        out["n_number_text"] = total(f"({short} AND {V.looks_numeric_with_commas('text')}) OR f IN (1, 3)")
        out["n_date_text"] = total(dated)
        out["has_date_hint"] = (
            f"coalesce(bool_or(({short} AND {V.has_date_hint('text')}) OR f >= 2), false)"
        )
        # this share is over distinct values, not rows
        dates.append(
            f"coalesce(count(1) FILTER (WHERE {dated}) >= 0.90D * "
            f"nullif(count(1) FILTER (WHERE {words} AND text IS NOT NULL), 0), false)"
        )
    if any(frame.kinds[p] in ("date", "timestamp") for p in positions):
        dates.append(f"coalesce(bool_or({members('date', 'timestamp')}), false)")
    if any(frame.kinds[p] == "numeric" for p in positions):
        compact = f"({V.seconds_from_compact_number(number)}) IS NOT NULL"
        dates.append(
            f"coalesce(bool_and({compact}) FILTER (WHERE {members('numeric')} AND {here}), false)"
        )
    out["is_date"] = "(" + " OR ".join(dates or ["false"]) + ")"
    return out


def _nested_stats(frame: Frame, p: int) -> DataFrame:
    """Arrays, maps, structs and binary: only missing values are counted."""
    zero = F.lit(0).cast("bigint")
    return frame.df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(frame.col(p).isNull()).alias("n_missing"),
        F.count(frame.col(p)).alias("n_non_missing"),
    ).select(
        F.lit(p).alias("pos"),
        "n_rows",
        "n_missing",
        "n_non_missing",
        F.when(F.col("n_non_missing") == 0, zero).alias("n_unique"),
        *[zero.alias(n) for n in ("max_count", "min_count", "n_nan", "n_pos_inf", "n_neg_inf")],
        *[zero.alias(n) for n in ("n_number_text", "n_date_text")],
        F.lit(False).alias("has_date_hint"),
        F.lit(False).alias("is_date"),
    )


def column_stats(frame: Frame, single_pass: bool | None = None) -> DataFrame:
    """One row per column with counts over its rows and its distinct values."""
    files = input_files(frame.df)
    if single_pass is None:
        single_pass = any(ROW_FORMATS.search(f) for f in files[:1])
    step = COLUMNS_PER_SCAN if single_pass else columns_per_scan(frame.df, frame.width, files)
    groups: dict[str, list[int]] = {}
    for p in range(frame.width):
        shape = _shape(frame, p)
        groups.setdefault("all" if single_pass and shape != "nested" else shape, []).append(p)
    parts = [_nested_stats(frame, p) for p in groups.pop("nested", [])]
    for members in groups.values():
        parts += [
            _stacked_stats(frame, members[i : i + step])
            for i in range(0, len(members), step)
        ]
    if not parts:
        return local_table(frame.df.sparkSession, [], STATS_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


# --- variable types ---------------------------------------------------------

# Decision list for the analytic type, first match wins.
TYPE_RULES = [
    ("n_unique <= 1", "excluded"),
    ("is_time_candidate", "date"),
    ("id_like_name AND n_non_missing >= 30 AND unique_ratio >= 0.9 AND kind <> 'nested'", "id"),
    ("kind = 'numeric' AND n_unique BETWEEN 2 AND 10", "numeric_categorical"),
    ("kind = 'numeric' AND n_unique >= 11", "numeric"),
    ("kind IN ('string', 'boolean') AND n_unique BETWEEN 2 AND 10", "categorical"),
]
# The plain decision list without date parsing and name rules.
SIMPLE_TYPE_RULES = [
    ("n_unique <= 1", "excluded"),
    ("kind IN ('date', 'timestamp')", "date"),
    ("kind = 'numeric' AND n_unique >= 11", "numeric"),
    ("kind = 'numeric'", "numeric_categorical"),
]


def _names_table(frame: Frame) -> DataFrame:
    return local_table(
        frame.df.sparkSession,
        [
            (p, name, frame.dtypes[p].simpleString(), frame.kinds[p], is_id_like_name(name))
            for p, name in enumerate(frame.names)
        ],
        "pos int, variable string, physical_type string, kind string, id_like_name boolean",
    )


def typed_profile(frame: Frame, mode: str = "full", single_pass: bool | None = None) -> DataFrame:
    """Column statistics with the analytic variable type decided per column."""
    rules, default = (TYPE_RULES, "other") if mode == "full" else (SIMPLE_TYPE_RULES, "categorical")
    counts = [
        f"coalesce({n}, 0L) AS {n}"
        for n in (
            "n_rows n_missing n_non_missing max_count min_count n_nan n_pos_inf n_neg_inf "
            "n_number_text n_date_text"
        ).split()
    ]
    names = T.StructType.fromDDL(TYPES_SCHEMA).names
    # one row per column on either side, so the broadcast is bounded by the schema
    return (
        _names_table(frame)
        .join(F.broadcast(column_stats(frame, single_pass)), "pos", "left")
        .selectExpr(
            "pos",
            "variable",
            "physical_type",
            "kind",
            "id_like_name",
            *counts,
            "if(n_rows IS NULL, 0L, n_unique) AS n_unique",
            "coalesce(has_date_hint, false) AS has_date_hint",
            "coalesce(is_date, false) AS is_time_candidate",
            "CASE WHEN n_non_missing > 0 THEN n_unique / n_non_missing ELSE 0D END AS unique_ratio",
        )
        .selectExpr(*names[:-1], f"{case_text(rules, default)} AS variable_type")
    )


@dataclass(frozen=True)
class Column_:
    """Profile of one column, as plain metadata."""

    pos: int
    variable: str
    physical_type: str
    kind: str
    n_rows: int
    n_missing: int
    n_non_missing: int
    n_unique: int | None
    unique_ratio: float
    max_count: int
    min_count: int
    n_nan: int
    n_pos_inf: int
    n_neg_inf: int
    n_number_text: int
    n_date_text: int
    has_date_hint: bool
    is_time_candidate: bool
    variable_type: str

    @property
    def missing_rate(self) -> float:
        return self.n_missing / self.n_rows if self.n_rows > 0 else 0.0

    @property
    def n_finite(self) -> int:
        return self.n_non_missing - self.n_pos_inf - self.n_neg_inf

    @property
    def is_id_by_ratio(self) -> bool:
        return self.n_non_missing >= 30 and self.unique_ratio >= 0.9


@dataclass(frozen=True)
class Profile:
    """A table's column metadata: one entry per column, gathered by one Spark job.

    The variable types decide which columns enter the next aggregate, so this (and
    only this) is brought to the driver; its size is the number of columns.
    """

    frame: Frame
    columns: tuple[Column_, ...]
    n_rows: int
    raw: DataFrame = field(repr=False)

    def of_type(self, *types: str) -> list[Column_]:
        return [c for c in self.columns if c.variable_type in types]

    def named(self, name: str) -> Column_:
        return self.columns[self.frame.position(name)]

    def table(self) -> DataFrame:
        names = T.StructType.fromDDL(TYPES_SCHEMA).names
        rows = [tuple(getattr(c, n) for n in names) for c in self.columns]
        return local_table(self.frame.df.sparkSession, rows, TYPES_SCHEMA)


def profile(
    df: DataFrame,
    user_missing_codes: Sequence[object] | None = None,
    mode: str = "full",
    single_pass: bool | None = None,
) -> Profile:
    """Run the profile job and keep its one row per column."""
    frame = frame_of(df, user_missing_codes)
    rows = typed_profile(frame, mode, single_pass).collect()
    columns = tuple(sorted((Column_(**r.asDict()) for r in rows), key=lambda c: c.pos))
    n_rows = columns[0].n_rows if columns else frame.df.count()
    return Profile(frame, columns, n_rows, df)


def variable_types(
    df: DataFrame, mode: str = "full", single_pass: bool | None = None
) -> DataFrame:
    """Type table: one row per column of ``df`` (lazy, one Spark query)."""
    return typed_profile(frame_of(df), mode, single_pass).select(
        "pos",
        "variable",
        "physical_type",
        "n_non_missing",
        "n_unique",
        V.rounded(F.col("unique_ratio"), 3).alias("unique_ratio"),
        "variable_type",
        "is_time_candidate",
    )


def column_summary(profiled: DataFrame) -> DataFrame:
    """Missing and distinct figures per column from a typed profile."""
    return profiled.select(
        "pos",
        "variable",
        "variable_type",
        F.col("n_missing").alias("missing_count"),
        V.percent(V.ratio(F.col("n_missing"), F.col("n_rows"))).alias("missing_percent"),
        F.col("n_non_missing").alias("non_missing_count"),
        F.col("n_unique").alias("unique_count"),
        V.rounded(V.ratio(F.col("n_unique"), F.col("n_non_missing")), 4).alias("unique_rate"),
    )


# Candidate lists offered for each kind of role.
CANDIDATES = {
    "numeric": "variable_type = 'numeric'",
    "categorical": "variable_type IN ('categorical', 'numeric_categorical')",
    "date": "variable_type = 'date' OR is_time_candidate",
}


def candidates(types: DataFrame, role: str) -> DataFrame:
    """Columns that may fill a role: ``numeric``, ``categorical`` or ``date``."""
    return types.where(CANDIDATES[role]).select("pos", "variable")


def role_candidates(types: DataFrame) -> DataFrame:
    """All candidate lists as (role, pos, variable), from one evaluation of the types."""
    roles = [F.when(F.expr(test), F.lit(role)) for role, test in CANDIDATES.items()]
    return types.select(
        F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull())).alias("role"), "pos", "variable"
    )
