"""Variable types without counting every distinct value.

A type depends on a column's distinct values only through limits: at most 1, at most 10, a
share of 0.9, and for texts the share of dates among them.  One scan folds each column to a
row of counts and an HLL sketch; no value is shuffled.  Sketches merge within slices of tasks
first, so that no task gets one from every other.  The type is decided at both ends of the range
that the sketch leaves for the distinct count; where the two agree, it is settled, since types
follow each other in order of that count.  The columns left in doubt are counted exactly.
These are those near a limit, which are mostly columns of few values, and texts of which some
look like dates and some do not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators.clean import Frame, frame_of
from plumbline.operators.local import local_table
from plumbline.operators.profile import SHORT_TEXT, is_id_like_name, typed_profile

#: 2^14 registers: a standard error of 0.0081, of which five and a half are allowed for
SKETCH_BITS, SKETCH_MARGIN = 14, 0.045
MERGE_SLICES = 64
#: Columns of one scan: a task holds a sketch of 16 KB for each.
SETTLED_COLUMNS = 200

SETTLED_SCHEMA = "pos int, variable string, variable_type string, is_time_candidate boolean, settled_by string"


@dataclass(frozen=True)
class Sketched:
    """What one scan tells of a column."""

    pos: int
    n_rows: int
    n_non_missing: int
    n_dated: int
    distinct: int

    @property
    def bounds(self) -> tuple[int, int]:
        """Least and most distinct values that go with the sketch."""
        least = math.floor(self.distinct * (1 - SKETCH_MARGIN))
        most = math.ceil(self.distinct * (1 + SKETCH_MARGIN))
        some = int(self.n_non_missing > 0)
        return max(some, min(least, self.n_non_missing)), max(some, min(most, self.n_non_missing))

    def is_time(self, kind: str) -> bool | None:
        """Does the column hold times?  None if that takes its distinct values."""
        if kind in ("date", "timestamp"):
            return self.n_rows > 0
        if kind not in ("numeric", "string") or not self.n_dated:
            return False
        if self.n_dated == self.n_non_missing:
            return True
        return None if kind == "string" else False


def _cell(frame: Frame, p: int) -> tuple[str, str, str]:
    """SQL of a column's test for a value, the value's hash and its test for a date."""
    x, dtype, kind = f"c{p}", frame.dtypes[p], frame.kinds[p]
    here = f"({x} IS NOT NULL" + (f" AND NOT isnan({x}))" if V.is_floating(dtype) else ")")
    if kind == "nested":
        return here, "CAST(NULL AS BIGINT)", "false"
    value = f"({x} + 0.0D)" if V.is_floating(dtype) else x  # one zero
    dated = "false"
    if kind == "numeric":
        dated = f"({V.seconds_from_compact_number(f'CAST({x} AS DOUBLE)')}) IS NOT NULL"
    elif kind == "string":
        dated = f"length({x}) <= {SHORT_TEXT} AND {V.looks_like_date(x)}"
    return here, f"if({here}, xxhash64({value}), NULL)", f"coalesce({here} AND {dated}, false)"


def sketched(frame: Frame, positions: Sequence[int]) -> DataFrame:
    """pos, n_rows, n_non_missing, n_dated, distinct (estimate): one scan, no value shuffled."""
    cells = [str(item) for p in positions for item in (p, *_cell(frame, p))]
    stacked = frame.df.selectExpr(f"stack({len(positions)}, {', '.join(cells)}) AS (pos, here, h, dated)")
    sliced = stacked.groupBy("pos", F.expr(f"spark_partition_id() % {MERGE_SLICES}").alias("slice")).agg(
        F.count("*").alias("n_rows"),
        F.count_if("here").alias("n_non_missing"),
        F.count_if("dated").alias("n_dated"),
        F.expr(f"hll_sketch_agg(h, {SKETCH_BITS})").alias("sketch"),
    )
    return sliced.groupBy("pos").agg(
        *[F.sum(n).alias(n) for n in ("n_rows", "n_non_missing", "n_dated")],
        F.expr("hll_sketch_estimate(hll_union_agg(sketch))").alias("distinct"),
    )


def _types_of(n: int, found: Sketched, kind: str, id_like: bool, is_time: bool) -> str:
    """The type of a column of ``n`` distinct values."""
    if n <= 1:
        return "excluded"
    if is_time:
        return "date"
    if id_like and kind != "nested" and found.n_non_missing >= 30 and n / found.n_non_missing >= 0.9:
        return "id"
    few = n <= 10
    if kind == "numeric":
        return "numeric_categorical" if few else "numeric"
    return "categorical" if few and kind in ("string", "boolean") else "other"


def settled_types(df: DataFrame) -> DataFrame:
    """pos, variable, variable_type, is_time_candidate, settled_by (``sketch`` or ``exact``) per column.

    The types equal those of ``variable_types``.  Nested columns, which have no distinct values
    to count, and empty tables are left to the exact way.
    """
    frame = frame_of(df)
    countable = [p for p in range(frame.width) if frame.kinds[p] != "nested"]
    found = {}
    for i in range(0, len(countable), SETTLED_COLUMNS):
        rows = sketched(frame, countable[i : i + SETTLED_COLUMNS]).collect()  # one per column
        found |= {r.pos: Sketched(**r.asDict()) for r in rows}
    out, doubtful = [], []
    for p, (name, kind) in enumerate(zip(frame.names, frame.kinds)):
        column = found.get(p)
        is_time = column.is_time(kind) if column else None
        ends = set()
        if is_time is not None:
            ends = {_types_of(n, column, kind, is_id_like_name(name), is_time) for n in column.bounds}
        if len(ends) == 1:
            out.append((p, name, ends.pop(), is_time, "sketch"))
        else:
            doubtful.append(p)
    if doubtful:
        view = df.toDF(*[f"x{i}" for i in range(frame.width)]).select(*[f"x{p}" for p in doubtful])
        exact = typed_profile(frame_of(view.toDF(*[frame.names[p] for p in doubtful]))).collect()
        out += [(doubtful[r.pos], r.variable, r.variable_type, r.is_time_candidate, "exact") for r in exact]
    return local_table(df.sparkSession, sorted(out), SETTLED_SCHEMA)
