"""Column helpers that fix how missing answers travel through conditions.

Spark's ``when(NULL, a).otherwise(b)`` yields ``b``.  A survey recode wants a
missing test to give a missing result instead, so categories are built with
:func:`fifelse` and not with bare ``when`` chains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fifelse(test: Column, yes: Any, no: Any) -> Column:
    """``yes`` where the test holds, ``no`` where it fails, NULL where it is NULL."""
    return F.when(test, as_column(yes)).when(~test, as_column(no))


def in_set(column: Column, codes: Iterable[Any]) -> Column:
    """Membership test that is false, never NULL, for a missing value."""
    return F.coalesce(column.isin(list(codes)), F.lit(False))


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def sentinel_to_null(column: Column, codes: Iterable[Any]) -> Column:
    """Turn non-response codes into NULL and keep every other value."""
    return F.when(~in_set(column, codes), column)


def sentinel_to_value(column: Column, replacements: Mapping[Any, Any]) -> Column:
    """Replace single codes by a value, for example 88 ("none") by 0, one after the other.

    A later replacement also applies to what an earlier one has put in.
    """
    steps = list(replacements.items())
    last = {}
    for start, (code, value) in enumerate(steps):
        for later, other in steps[start + 1:]:
            value = other if value == later else value
        last[code] = value
    return update(column, [(column == code, value) for code, value in last.items()])


Rule = tuple[Column | Callable[[Column], Column], Any]


def update(column: Column, rules: Sequence[Rule]) -> Column:
    """Apply ``(condition, value)`` assignments one after the other.

    A condition that is a function is given the column as the rules before have
    left it; a plain condition sees the row as it came.  A rule whose condition
    is NULL leaves the row as it was.
    """
    for condition, value in rules:
        test = condition(column) if callable(condition) else condition
        column = F.when(test, as_column(value)).otherwise(column)
    return column


def fill_missing(column: Column, label: str = "Missing") -> Column:
    return F.coalesce(column, F.lit(label))
