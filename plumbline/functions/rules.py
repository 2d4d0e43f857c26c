"""Threshold tables turned into ``CASE WHEN`` expressions.

Each table becomes one SQL text and so one expression: building a plan costs a single
call to the JVM however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: object) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def case_text(rules: Sequence[tuple[str, object]], default: object) -> str:
    """``CASE WHEN cond1 THEN value1 ... ELSE default END`` as SQL text."""
    if not rules:
        return literal(default)
    body = " ".join(f"WHEN {condition} THEN {literal(value)}" for condition, value in rules)
    return f"CASE {body} ELSE {literal(default)} END"


def first_match(rules: Sequence[tuple[str, object]], default: object) -> Column:
    """Value of the first rule whose SQL condition holds."""
    return F.expr(case_text(rules, default))


def band(metric: str, op: str, steps: Iterable[tuple[float, float]], default: float) -> Column:
    """Points for one metric compared with falling or rising limits."""
    return first_match([(f"{metric} {op} {limit}", points) for limit, points in steps], default)


def codes_text(rules: Sequence[tuple[str, str]]) -> str:
    """SQL text of the array of codes whose condition holds, in rule order."""
    if not rules:
        return "CAST(array() AS array<string>)"
    cells = ", ".join(f"CASE WHEN {condition} THEN {literal(code)} END" for code, condition in rules)
    return f"filter(array({cells}), x -> x IS NOT NULL)"


def matching_codes(rules: Sequence[tuple[str, str]]) -> Column:
    """Array of the codes whose SQL condition holds, in rule order."""
    return F.expr(codes_text(rules))
