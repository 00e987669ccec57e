"""NULL-safe joins and scalar back-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.scratch import settle


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a missing key matches a missing key.

    There is no broadcast hint: adaptive execution measures both inputs,
    broadcasts a small one and splits a hot key of a large one.
    """
    same = [F.col(f"l.`{key}`").eqNullSafe(F.col(f"r.`{key}`")) for key in on]
    joined = left.alias("l").join(right.alias("r"), reduce(Column.__and__, same), how)
    return joined.select(*[F.col(f"l.`{c}`") for c in left.columns],
                         *[F.col(f"r.`{c}`") for c in right.columns if c not in on])


def left_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep every left row and add the other columns of the matching right rows."""
    return null_safe_join(left, right, on, "left")


def attach(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left_merge`` of an aggregate onto a large table.

    The aggregate is written first, so the planner knows its bytes: below the
    session's broadcast threshold the large table is not shuffled, above it both
    sides are, and hot keys are left to adaptive execution.
    """
    return left_merge(big, settle(small), on)


def scalars(summary: DataFrame) -> dict[str, Column]:
    """The columns of a one-row aggregate as scalars for expressions over another table.

    Each one is an uncorrelated scalar subquery: Spark evaluates the aggregate
    once and substitutes the value, so no join and no shuffle of
    the table it is used on.
    """
    packed = summary.select(F.struct(*summary.columns).alias("s")).scalar()
    return {name: packed.getField(name) for name in summary.columns}
