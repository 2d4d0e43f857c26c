"""Cleaning projections: missing tokens, user missing codes, column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.functions.rules import literal


class BadInput(ValueError):
    """A call names a column that the table lacks, or gives something that is no name."""


#: Longer chains of conditions become arrays.
LONGEST_CHAIN = 64


def _codes_as_numbers(codes: Sequence[object]) -> list[float]:
    out = []
    for code in codes:
        try:
            out.append(float(str(code).strip()))
        except ValueError:
            continue
    return out


def normalized(x: str, dtype: T.DataType, codes: Sequence[object] | None = None) -> str:
    """SQL text of one column with missing tokens (strings) and the caller's codes as NULL."""
    kind = V.kind_of(dtype)
    labels = [str(code).strip() for code in codes or ()]
    if kind == "string":
        return V.text_or_null(x, labels)
    if not labels or kind == "nested":
        return x
    if kind == "numeric":
        numbers = ", ".join(f"{n!r}D" for n in _codes_as_numbers(codes))
        return f"CASE WHEN CAST({x} AS DOUBLE) NOT IN ({numbers}) THEN {x} END" if numbers else x
    text = f"CAST({x} AS STRING)"
    if kind == "boolean":
        text, labels = f"upper({text})", [label.upper() for label in labels]
    return f"CASE WHEN {text} NOT IN ({', '.join(map(literal, labels))}) THEN {x} END"


@dataclass(frozen=True)
class Frame:
    """A table addressed by position: columns ``c0..cn`` plus their original names.

    Positions keep blank and repeated column names usable; ``names`` and ``dtypes``
    are the side table back to the caller's schema.
    """

    df: DataFrame
    names: tuple[str, ...]
    dtypes: tuple[T.DataType, ...]

    @property
    def width(self) -> int:
        return len(self.names)

    @property
    def kinds(self) -> tuple[str, ...]:
        return tuple(V.kind_of(t) for t in self.dtypes)

    def col(self, position: int) -> Column:
        return F.col(f"c{position}")

    def missing(self, position: int) -> Column:
        return V.is_missing(self.col(position), self.dtypes[position])

    def present(self, position: int) -> Column:
        return ~self.missing(position)

    def finite(self, position: int) -> Column:
        return V.finite_double(self.col(position), self.dtypes[position])

    def position(self, name: str) -> int:
        if name not in self.names:
            raise BadInput(f"no column {name!r}")
        return self.names.index(name)

    def positions(self, names: Iterable[str]) -> list[int]:
        return [self.position(n) for n in names]

    def _combined(self, positions: Sequence[int], word: str, deciding: str) -> Column:
        """The presence tests joined by AND or OR; ``deciding`` is the outcome that settles it.

        The optimizer nests a chain as deep as it is long, so a long one becomes an array of tests.
        """
        cells = [(f"c{p}", V.is_floating(self.dtypes[p])) for p in positions]
        tests = [f"({x} IS NOT NULL AND NOT isnan({x}))" if floating else f"{x} IS NOT NULL" for x, floating in cells]
        if len(tests) <= LONGEST_CHAIN:
            return F.expr(f" {word} ".join(tests) or ("false" if deciding == "true" else "true"))
        found = f"array_contains(array({', '.join(tests)}), {deciding})"
        return F.expr(found if deciding == "true" else f"NOT {found}")

    def any_present(self, positions: Sequence[int]) -> Column:
        """At least one of the columns has a value in this row."""
        return self._combined(positions, "OR", "true")

    def all_present(self, positions: Sequence[int]) -> Column:
        """Every one of the columns has a value in this row."""
        return self._combined(positions, "AND", "false")


def frame_of(
    df: DataFrame, codes: Sequence[object] | None = None, extra: Mapping[str, str] | None = None
) -> Frame:
    """Positional, normalised view of a table (no data is read).

    ``extra`` adds columns, as SQL over the columns ``c0``, ``c1``, ... as they were read.
    """
    names = tuple(df.columns)
    dtypes = tuple(f.dataType for f in df.schema.fields)
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    cleaned = renamed.select(
        *[F.expr(normalized(f"c{i}", t, codes)).alias(f"c{i}") for i, t in enumerate(dtypes)],
        *[F.expr(sql).alias(name) for name, sql in (extra or {}).items()],
    )
    return Frame(cleaned, names, dtypes)


def standardize(df: DataFrame, user_missing_codes: Sequence[object] | None = None) -> DataFrame:
    """Same table, same column names, with missing values normalised in every column."""
    return frame_of(df, user_missing_codes).df.toDF(*df.columns)


def clean_names(names: object) -> list[str]:
    """Flatten, trim, drop blanks and repeats from a selection of column names."""
    if names is None:
        return []
    if not isinstance(names, (str, list, tuple, set, frozenset)):
        raise BadInput(f"a column name or a list of them was expected, not {names!r}")
    items = [names] if isinstance(names, str) else list(names)
    out: list[str] = []
    for item in items:
        for name in clean_names(item) if isinstance(item, (list, tuple)) else [item]:
            if name is None:
                continue
            text = str(name).strip()
            if text and text not in out:
                out.append(text)
    return out


def predictors(columns: Sequence[str], chosen: object, response: str | None) -> list[str]:
    """Explanatory columns: the chosen ones that exist (default all), never the response."""
    wanted = clean_names(chosen) or list(columns)
    kept = [c for c in dict.fromkeys(wanted) if c in columns]
    return [c for c in kept if c != response]
