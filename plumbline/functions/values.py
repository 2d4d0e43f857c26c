"""Expressions over single values: missing tokens, numbers and dates in text.

The text functions take and return SQL text, so that a whole parse is one expression;
everything is built into Spark and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.rules import literal

# Strings (after trimming) that mean "missing", case-sensitive.
MISSING_TOKENS = ["", "NA", "N/A", "na", "n/a", "null", "NULL", ".", "NaN", "-"]

# Fixed value: characters removed at both ends of a string (SQL escapes).
BLANKS = [" ", r"\t", r"\r", r"\n"]

NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
DATE_PATTERN = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
DATETIME_PATTERN = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
COMPACT_PATTERN = r"^(\d{4})(\d{2})(\d{2})$"
SLASH_PATTERN = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
# Fixed value: "looks a bit like a date" anywhere in the text.
DATE_HINT_PATTERN = r"\d{4}[-/.]?\d{1,2}[-/.]?\d{1,2}"

SECONDS_PER_DAY = 86_400


def kind_of(dtype: T.DataType) -> str:
    """Physical class of a column: numeric, string, boolean, date, timestamp, nested."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "nested"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def trimmed(x: str) -> str:
    """Blanks removed at both ends; long texts without any are passed through untouched."""
    edge = ", ".join(f"'{c}'" for c in BLANKS)
    return (
        f"CASE WHEN left({x}, 1) IN ({edge}) OR right({x}, 1) IN ({edge}) "
        f"THEN btrim({x}, '{''.join(BLANKS)}') ELSE {x} END"
    )


def text_or_null(x: str, extra: list[str] = ()) -> str:
    """Trim, then turn the missing tokens (and any extra ones) into NULL."""
    tokens = ", ".join(literal(t) for t in [*MISSING_TOKENS, *extra])
    t = trimmed(x)
    return f"CASE WHEN ({t}) NOT IN ({tokens}) THEN {t} END"


def is_missing(c: Column, dtype: T.DataType) -> Column:
    """Missing test for an already normalised column: NULL or NaN."""
    return (c.isNull() | F.isnan(c)) if is_floating(dtype) else c.isNull()


def present(c: Column, dtype: T.DataType) -> Column:
    return ~is_missing(c, dtype)


def finite_double(c: Column, dtype: T.DataType) -> Column:
    """The value as a double, NULL when missing or infinite."""
    d = c.cast("double")
    if not is_floating(dtype):
        return d
    return F.when(~F.isnan(c) & (F.abs(d) < F.lit(float("inf"))), d)


def looks_numeric(x: str) -> str:
    """Does trimmed text hold a number?"""
    return f"({x} RLIKE r'{NUMBER_PATTERN}')"


def looks_numeric_with_commas(x: str) -> str:
    """Number test that ignores thousands separators."""
    return looks_numeric(f"replace({x}, ',', '')")


def number_from_text(x: str) -> str:
    """Number held in trimmed text, NULL when there is none."""
    return f"CASE WHEN {looks_numeric(x)} THEN try_cast({x} AS DOUBLE) END"


def has_date_hint(x: str) -> str:
    return f"({x} RLIKE r'{DATE_HINT_PATTERN}')"


def _day(x: str, pattern: str, target: str) -> str:
    return f"unix_date(try_cast(regexp_replace({x}, r'{pattern}', '{target}') AS DATE))"


def seconds_from_text(x: str) -> str:
    """Seconds since 1970-01-01 for trimmed date or date-time text, else NULL.

    Four-digit year, one- or two-digit month and day, the whole text must match;
    month/day/year is tried before day/month/year.
    """
    hour, minute, second = (
        f"try_cast(regexp_extract({x}, r'{DATETIME_PATTERN}', {g}) AS INT)" for g in (5, 6, 7)
    )
    clock = (
        f"CASE WHEN {hour} <= 23 AND {minute} <= 59 AND {second} <= 59 "
        f"THEN {hour} * 3600 + {minute} * 60 + {second} END"
    )
    day = SECONDS_PER_DAY
    return (
        f"CASE WHEN {x} RLIKE r'{DATE_PATTERN}' "
        f"THEN {_day(x, DATE_PATTERN, '$1-$3-$4')} * {day}L "
        f"WHEN {x} RLIKE r'{COMPACT_PATTERN}' "
        f"THEN {_day(x, COMPACT_PATTERN, '$1-$2-$3')} * {day}L "
        f"WHEN {x} RLIKE r'{SLASH_PATTERN}' "
        f"THEN coalesce({_day(x, SLASH_PATTERN, '$3-$1-$2')}, {_day(x, SLASH_PATTERN, '$3-$2-$1')}) * {day}L "
        f"WHEN {x} RLIKE r'{DATETIME_PATTERN}' "
        f"THEN {_day(x, DATETIME_PATTERN, '$1-$3-$4')} * {day}L + {clock} END"
    )


def looks_like_date(x: str) -> str:
    return f"({seconds_from_text(x)}) IS NOT NULL"


def seconds_from_compact_number(x: str) -> str:
    """Seconds for a whole number (a double) written YYYYMMDD, else NULL."""
    text = f"CAST(CAST({x} AS BIGINT) AS STRING)"
    return (
        f"CASE WHEN {x} >= 1e7D AND {x} < 1e8D AND {x} = floor({x}) "
        f"THEN {_day(text, COMPACT_PATTERN, '$1-$2-$3')} * {SECONDS_PER_DAY}L END"
    )


def micros_text(x: str, dtype: T.DataType) -> str:
    """Microseconds since 1970-01-01 of a timestamp, as SQL text."""
    if isinstance(dtype, T.TimestampNTZType):
        # no session time zone involved, so a clock change cannot merge two values
        return (
            f"((unix_date(CAST({x} AS DATE)) * 1440L + hour({x}) * 60 + minute({x})) * 60000000L "
            f"+ CAST(extract(SECOND FROM {x}) * 1000000 AS BIGINT))"
        )
    return f"unix_micros({x})"


def seconds_from_timestamp(x: str, dtype: T.DataType) -> Column:
    """Seconds (with fraction) since 1970-01-01 for a date or timestamp column."""
    if isinstance(dtype, T.DateType):
        return F.expr(f"CAST(unix_date({x}) * {SECONDS_PER_DAY}L AS DOUBLE)")
    return F.expr(f"CAST({micros_text(x, dtype)} AS DOUBLE) / 1e6D")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 when the denominator is not positive or unknown."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def rounded(c: Column, digits: int) -> Column:
    """Round to a number of digits, ties to the even neighbour."""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def percent(rate: Column, digits: int = 2) -> Column:
    return rounded(rate * F.lit(100.0), digits)
