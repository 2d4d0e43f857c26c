"""Exact order statistics and quantiles for many columns at once.

``percentile`` keeps every distinct value of a group in one task, which does not
hold for columns with billions of values.  Here each wanted rank is bracketed instead:

1. a KLL sketch gives a value just below and just above the wanted rank; sketches are merged
   in two levels, so no task gets one from every other,
2. exact counts below, at and between the two values tell whether the rank is one of
   the two values (found), lies strictly between them (the new bracket), or was missed
   (the next try is wider),
3. steps 1-2 repeat on the bracket until it holds at most ``limit`` rows,
4. the order statistics are read from the few rows left.

A bracket always loses its two ends, so the search ends, and a value repeated billions
of times ends it at once.  Once every column of a scan has a bracket, the brackets are its
filter.  Every step is one query of wide aggregates; what reaches the driver is a handful
of numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scans import columns_per_scan, input_files

BRACKET_ROWS = 100_000
COLUMNS_PER_JOB = 40
ACCURACY = 4096  # size of a sketch; its rank error is about 4 / size
MERGE_GROUPS = 64


@dataclass
class _Search:
    """One wanted order statistic (rank counted from 0) inside the open bracket (lo, hi)."""

    name: str
    rank: int
    inside: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    slack: float = 2.0
    found: float | None = None

    @property
    def bracket(self) -> str | None:
        """The condition of being inside, if there are ends yet."""
        return None if self.lo is None else f"`{self.name}` > {self.lo!r}D AND `{self.name}` < {self.hi!r}D"

    @property
    def inner(self) -> str:
        """The value if it lies inside."""
        return f"CASE WHEN {self.bracket} THEN `{self.name}` END" if self.bracket else f"`{self.name}`"

    def percentiles(self, wanted: Sequence[float], accuracy: int) -> Column:
        """Quantiles of the few values inside the bracket."""
        return F.expr(
            f"percentile_approx({self.inner}, array({', '.join(f'{w!r}D' for w in wanted)}), {accuracy})"
        )

    def settle(self, lo: float, hi: float, counts: Sequence[float]) -> None:
        """Use the exact counts inside the bracket: below lo, at lo, between and at hi."""
        below, at_lo, between, at_hi = (int(c) for c in counts)
        below += self.below
        if lo == hi:
            at_hi = 0
        if not below <= self.rank < below + at_lo + between + at_hi:
            self.slack *= 4.0
        elif self.rank < below + at_lo:
            self.found = lo
        elif self.rank >= below + at_lo + between:
            self.found = hi
        else:
            self.lo, self.hi, self.below, self.inside = lo, hi, below + at_lo, between


def _branches(searches: Sequence[_Search], step: int) -> list[list[int]]:
    """Positions of the searches per scan, ``step`` columns each."""
    order = list(dict.fromkeys(s.name for s in searches))
    out: dict[int, list[int]] = {}
    for i, s in enumerate(searches):
        out.setdefault(order.index(s.name) // step, []).append(i)
    return list(out.values())


def _inside(df: DataFrame, searches: Sequence[_Search]) -> DataFrame:
    """The rows that some search still needs."""
    brackets = [s.bracket for s in searches]
    if not all(brackets):
        return df
    return df.where(" OR ".join(f"({b})" for b in dict.fromkeys(brackets)))


def _gather(parts: list[DataFrame], branches: list[list[int]], n: int) -> list[list[float]]:
    """One row per scan, its arrays dealt back to the searches."""
    if not parts:
        return []
    out: list[list[float]] = [[] for _ in range(n)]
    tagged = [part.select(F.lit(b).alias("branch"), "found") for b, part in enumerate(parts)]
    for row in reduce(DataFrame.unionByName, tagged).collect():
        for i, found in zip(branches[row["branch"]], row["found"]):
            out[i] = found
    return out


def _exact(df: DataFrame, asks: Sequence[tuple[_Search, Column]], step: int) -> list[list[float]]:
    """Evaluate ``(search, aggregate giving array<double>)`` pairs in one query.

    Aggregates are spread over scans by column; every scan reads only its own columns and
    the scans run side by side.
    """
    searches = [s for s, _ in asks]
    branches = _branches(searches, step)
    parts = [
        _inside(df, [searches[i] for i in members]).agg(F.array(*[asks[i][1] for i in members]).alias("found"))
        for members in branches
    ]
    return _gather(parts, branches, len(asks))


def _sketched(
    df: DataFrame, asks: Sequence[tuple[_Search, Sequence[float]]], accuracy: int, step: int
) -> list[list[float]]:
    """Approximate quantiles of each search's inner values: sketches per task, merged in two levels."""
    searches = [s for s, _ in asks]
    branches = _branches(searches, step)
    parts = []
    for members in branches:
        rows = _inside(df, [searches[i] for i in members])
        group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("merge_group")
        cells = [F.expr(searches[i].inner).alias(f"v{i}") for i in members]
        first = rows.select(group, *cells).groupBy("merge_group").agg(
            *[F.kll_sketch_agg_double(f"v{i}", accuracy).alias(f"s{i}") for i in members]
        )
        merged = first.agg(*[F.kll_merge_agg_double(f"s{i}", accuracy).alias(f"s{i}") for i in members])
        ranks = {i: F.array(*[F.lit(float(w)) for w in asks[i][1]]) for i in members}
        parts.append(
            merged.select(
                F.array(*[F.kll_sketch_get_quantile_double(f"s{i}", ranks[i]) for i in members]).alias("found")
            )
        )
    return _gather(parts, branches, len(asks))


def _narrow(df: DataFrame, searches: list[_Search], limit: int, accuracy: int, step: int) -> None:
    open_ = [s for s in searches if s.found is None and s.inside > limit]
    while open_:
        # searches that still share a bracket share one sketch
        shared: dict[tuple, list[_Search]] = {}
        for s in open_:
            shared.setdefault((s.name, s.lo, s.hi), []).append(s)
        asks = []
        for group in shared.values():
            wanted = []
            for s in group:
                spot, pad = (s.rank - s.below + 0.5) / s.inside, 4 * s.slack / accuracy
                wanted += [max(spot - pad, 0.0), min(spot + pad, 1.0)]
            asks.append((group[0], wanted))
        ends = {}
        for group, found in zip(shared.values(), _sketched(df, asks, accuracy, step)):
            for i, s in enumerate(group):
                ends[id(s)] = (found[2 * i], found[2 * i + 1])
        counts = []
        for s in open_:
            x, (lo, hi) = s.inner, ends[id(s)]
            lo_text, hi_text = f"{lo!r}D", f"{hi!r}D"
            tests = (f"({x}) < {lo_text}", f"({x}) = {lo_text}")
            tests += (f"({x}) > {lo_text} AND ({x}) < {hi_text}", f"({x}) = {hi_text}")
            cells = ", ".join(f"CAST(count_if({t}) AS DOUBLE)" for t in tests)
            counts.append((s, F.expr(f"array({cells})")))
        for s, counted in zip(open_, _exact(df, counts, step)):
            s.settle(*ends[id(s)], counted)
        open_ = [s for s in searches if s.found is None and s.inside > limit]


def order_statistics(
    df: DataFrame,
    ranks: Sequence[tuple[str, int, int]],
    limit: int = BRACKET_ROWS,
    accuracy: int = ACCURACY,
    columns_per_job: int | None = None,
) -> list[float]:
    """Exact value at each ``(double column, rank, row count)``, ranks from 0.

    NULLs are ignored; row count is the number of non-NULL values of the column.
    """
    wanted = list(dict.fromkeys(ranks))
    searches = [_Search(name, rank, n) for name, rank, n in wanted]
    if columns_per_job is None:
        names = {name for name, _, _ in ranks}
        columns_per_job = min(COLUMNS_PER_JOB, columns_per_scan(df, len(names), input_files(df)))
    _narrow(df, searches, limit, accuracy, columns_per_job)
    rest: dict[tuple, list[_Search]] = {}
    for s in searches:
        if s.found is None:
            rest.setdefault((s.name, s.lo, s.hi), []).append(s)
    # at this accuracy the sketch keeps every one of the few rows of the bracket
    asks = [
        (
            group[0],
            group[0].percentiles(
                [(s.rank - s.below + 0.5) / s.inside for s in group], 4 * max(group[0].inside, 2_500)
            ),
        )
        for group in rest.values()
    ]
    for group, found in zip(rest.values(), _exact(df, asks, columns_per_job)):
        for s, value in zip(group, found):
            s.found = value
    by_rank = {w: s.found for w, s in zip(wanted, searches)}
    return [by_rank[r] for r in ranks]


def quantiles(
    df: DataFrame,
    sizes: dict[str, int],
    probabilities: Sequence[float],
    **options: int,
) -> dict[str, list[float]]:
    """Exact linear-interpolation quantiles (type 7) of double columns.

    ``sizes`` gives the non-NULL row count of every column; empty columns are left out.
    """
    asks: list[tuple[str, int, int]] = []
    parts: list[tuple[str, float]] = []
    for name, n in sizes.items():
        for p in probabilities:
            if n > 0:
                spot = (n - 1) * p
                low = math.floor(spot)
                asks += [(name, low, n), (name, min(low + 1, n - 1), n)]
                parts.append((name, spot - low))
    values = order_statistics(df, asks, **options)
    out: dict[str, list[float]] = {}
    for i, (name, h) in enumerate(parts):
        a, b = values[2 * i], values[2 * i + 1]
        out.setdefault(name, []).append(a if h == 0 or a == b else (1 - h) * a + h * b)
    return out
