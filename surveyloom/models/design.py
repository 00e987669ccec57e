"""Model terms, treatment contrasts and counted answer patterns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.scratch import settle


@dataclass(frozen=True)
class Term:
    """One predictor: a factor with ordered levels, or a number if it has none.

    The first level of a factor is its base.
    """

    name: str
    levels: tuple[str, ...] = ()

    @property
    def is_factor(self) -> bool:
        return bool(self.levels)

    def usable(self) -> Column:
        column = F.col(self.name)
        return column.cast("string").isin(list(self.levels)) if self.is_factor else column.isNotNull()

    def contrasts(self) -> dict[str, Column]:
        """Design columns by name: one indicator per level after the first, or the number itself."""
        column = F.col(self.name)
        if not self.is_factor:
            return {self.name: column.cast("double")}
        return {name: (column.cast("string") == level).cast("double")
                for name, level in zip(self.contrast_names(), self.levels[1:])}

    def contrast_names(self) -> list[str]:
        return [f"{self.name}{level}" for level in self.levels[1:]] if self.is_factor else [self.name]

    def position(self) -> Column:
        """Level position from 0 for a factor, the value for a number."""
        column = F.col(self.name)
        if not self.is_factor:
            return column.cast("double")
        labels = F.array(*map(F.lit, self.levels))
        return (F.array_position(labels, column.cast("string")) - 1).cast("double")


def design_columns(terms: Sequence[Term]) -> dict[str, Column]:
    return {name: column for term in terms for name, column in term.contrasts().items()}


def complete_rows(df: DataFrame, terms: Sequence[Term], response: str) -> DataFrame:
    """Rows with an answer to every term and to the response."""
    usable = [term.usable() for term in terms]
    return df.where(reduce(Column.__and__, usable, F.col(response).isNotNull()))


def design_matrix(df: DataFrame, terms: Sequence[Term], response: str, positive: str,
                  keep: Sequence[str] = ()) -> DataFrame:
    """The numeric design of a model, with the 0/1 response as ``y``."""
    y = (F.col(response) == positive).cast("double").alias("y")
    columns = [column.alias(name) for name, column in design_columns(terms).items()]
    return complete_rows(df, terms, response).select(*keep, y, *columns)


def answer_patterns(df: DataFrame, terms: Sequence[Term], response: str, positive: str,
                    keep: Sequence[Column] = ()) -> DataFrame:
    """Distinct combinations of answers with the number of rows (``weight``)
    and of positive rows (``positive``).

    A model fitted to the counted patterns equals one fitted to the rows.
    Coded answers repeat, so the table is read once and the many passes of
    a fit run over the far smaller patterns.
    """
    keys = [F.col(term.name) for term in terms]
    counted = complete_rows(df, terms, response).groupBy(*keep, *keys).agg(
        F.count("*").cast("double").alias("weight"),
        F.count_if(F.col(response) == positive).cast("double").alias("positive"))
    return settle(counted)


def by_class(patterns: DataFrame) -> DataFrame:
    """Counted patterns with one row per class: the 0/1 response ``y`` and its ``weight``."""
    classes = F.array(F.struct(F.lit(0.0).alias("y"), (F.col("weight") - F.col("positive")).alias("weight")),
                      F.struct(F.lit(1.0).alias("y"), F.col("positive").alias("weight")))
    rest = [c for c in patterns.columns if c not in ("weight", "positive")]
    return patterns.select(*rest, F.inline(classes)).where("weight > 0")


def uniform(*parts: Column | str) -> Column:
    """A number from 0 up to 1 from the MD5 of the parts joined by colons, the same in every engine."""
    key = F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / 2 ** 32
