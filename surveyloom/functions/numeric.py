"""Numeric column helpers: binning, unit decoding, rounding, thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.nulls import fifelse


def cut(column: Column, breaks: Sequence[float], labels: Sequence[str],
        include_lowest: bool = True) -> Column:
    """Label right-closed intervals ``(a, b]``; values outside the breaks, and NaN, give NULL.

    ``ml.feature.Bucketizer`` closes its intervals on the left, which puts
    every break value into the wrong bin for this purpose.
    """
    if len(labels) != len(breaks) - 1:
        raise ValueError("cut needs one label per interval")
    lowest = column >= breaks[0] if include_lowest else column > breaks[0]
    binned = None
    for upper, label in zip(breaks[1:], labels):
        inside = lowest if math.isinf(upper) else (column <= upper) & lowest
        binned = F.when(inside, label) if binned is None else binned.when(inside, label)
    # NaN sorts above every number, so an open top interval would take it.
    return F.when(~F.isnan(column.cast("double")), binned)


@dataclass(frozen=True)
class UnitRule:
    """Codes from ``low`` to ``high`` mean ``(code - offset) * factor``; ``factor=None`` means no answer."""

    low: float
    high: float
    offset: float = 0
    factor: float | None = 1


def decode_units(column: Column, rules: Sequence[UnitRule]) -> Column:
    """Decode a column that mixes units by code range; other codes stay as they are."""
    decoded = None
    for rule in rules:
        value = F.lit(None) if rule.factor is None else (column - rule.offset) * rule.factor
        test = column == rule.low if rule.low == rule.high else column.between(rule.low, rule.high)
        decoded = F.when(test, value) if decoded is None else decoded.when(test, value)
    return decoded.otherwise(column)


def round_even(column: Column, digits: int = 0) -> Column:
    """Round a double with ties to the even digit.

    Ties are judged on the shortest decimal text of the number, so 2.675 is a
    tie at two digits although its binary value is a little less.  That text has
    at most 17 digits, so a number from 10 ** (16 - digits) on has no further
    digit to round and stays as it is, as do NaN and the infinities.
    """
    if not 0 <= digits <= 16:
        raise ValueError("round_even serves 0 to 16 digits")
    value = column.cast("double")
    rounded = F.bround(value.cast(f"decimal(38,{digits + 17})"), digits).cast("double")
    return F.when(F.abs(value) < 10.0 ** (16 - digits), rounded).otherwise(value)


def label_above(score: Column, threshold: Column | float, yes: str = "Yes", no: str = "No") -> Column:
    """``yes`` for a score strictly above the threshold, NULL for a missing score."""
    return fifelse(score > threshold, yes, no)
