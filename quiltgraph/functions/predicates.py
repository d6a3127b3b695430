"""Two-valued, null-safe predicates.

Equality is total: null equals null, and a value equals no null. Values of
different kinds are unequal and never ordered; numbers compare across integer
and floating point; NaN equals nothing. Spark's ANSI coercion is never reached,
as only columns of the literal's kind are compared.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltgraph.model import kind_of_value

#: A property as its columns with their kinds; none for one that no entity has.
Values = Sequence[tuple[Column, str]]

ORDERED = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def is_null(values: Values) -> Column:
    return reduce(operator.and_, [c.isNull() for c, _ in values]) if values else F.lit(True)


def literal(value: Any) -> Column:
    if isinstance(value, list | tuple):
        return F.array(*map(literal, value))
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return F.lit(str(value)).cast("decimal(38,0)")
    if isinstance(value, bytes):
        return F.lit(bytearray(value))
    return F.lit(value)


def equals(values: Values, value: Any) -> Column:
    """``=``; for null, whether the property is missing."""
    if value is None:
        return is_null(values)
    if isinstance(value, float) and value != value or isinstance(value, dict):
        return F.lit(False)
    kind = kind_of_value(value)
    tests = [c.eqNullSafe(literal(value)) for c, k in values if k == kind]
    return reduce(operator.or_, tests) if tests else F.lit(False)


def differs(values: Values, value: Any) -> Column:
    return ~equals(values, value)


def compares(values: Values, op: str, value: Any) -> Column:
    """``< <= > >=``: false where either side is null or the kinds differ."""
    if value is None or kind_of_value(value) == "other" or isinstance(value, float) and value != value:
        return F.lit(False)
    kind = kind_of_value(value)
    tests = [ORDERED[op](c, literal(value)) & _not_nan(c, kind) for c, k in values if k == kind]
    return F.coalesce(reduce(operator.or_, tests), F.lit(False)) if len(tests) > 1 else tests[0] if tests else F.lit(False)


def _not_nan(column: Column, kind: str) -> Column:
    return ~F.isnan(column.cast("double")) if kind == "number" else F.lit(True)


def is_in(values: Values, choices: Sequence[Any]) -> Column:
    """``IN``: a null among the choices matches missing values."""
    by_kind: dict[str, list[Any]] = {}
    tests = []
    for choice in choices:
        if choice is None:
            tests.append(is_null(values))
        elif kind_of_value(choice) == "other":
            tests.append(equals(values, choice))
        elif choice == choice:
            by_kind.setdefault(kind_of_value(choice), []).append(literal(choice))
    for kind, some in by_kind.items():
        tests += [F.coalesce(c.isin(some), F.lit(False)) for c, k in values if k == kind]
    return reduce(operator.or_, tests) if tests else F.lit(False)


def within(values: Values, start: Any, end: Any, include_start: bool = True, include_end: bool = True) -> Column:
    """A range whose bounds may be open (None). Bounds of different or unordered kinds hold nothing."""
    bounds = [b for b in (start, end) if b is not None]
    kinds = {kind_of_value(b) for b in bounds}
    if len(kinds) > 1 or kinds & {"other", "boolean"}:
        return F.lit(False)
    if not bounds:
        return F.coalesce(reduce(operator.or_, [c.isNotNull() for c, k in values if k in ("number", "string")], F.lit(False)), F.lit(False))
    tests = []
    if start is not None:
        tests.append(compares(values, ">=" if include_start else ">", start))
    if end is not None:
        tests.append(compares(values, "<=" if include_end else "<", end))
    return reduce(operator.and_, tests)
