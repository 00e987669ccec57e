"""Closed, ordered level lists for categorical columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Levels:
    """The allowed labels of a column in their declared order."""

    labels: tuple[str, ...]

    @classmethod
    def of(cls, labels: Iterable[str]) -> "Levels":
        return cls(tuple(dict.fromkeys(labels)))

    def with_label(self, label: str) -> "Levels":
        return Levels.of((*self.labels, label))

    def ordinal(self, column: Column) -> Column:
        """Position of the label, from 1; NULL for a label that is not declared."""
        return F.nullif(F.array_position(F.array(*map(F.lit, self.labels)), column), F.lit(0))

    def table(self, spark: SparkSession) -> DataFrame:
        """The level list as a two-column table ``level, ord``."""
        rows = F.array(*[F.struct(F.lit(label).alias("level"), F.lit(i).alias("ord"))
                         for i, label in enumerate(self.labels, start=1)])
        return spark.range(1).select(F.inline(rows))


@dataclass(frozen=True)
class Codebook:
    """Code to label assignments; several codes may share one label."""

    pairs: tuple[tuple[Any, str], ...]

    @classmethod
    def of(cls, mapping: Mapping[Any, str]) -> "Codebook":
        return cls(tuple(mapping.items()))

    @property
    def levels(self) -> Levels:
        return Levels.of(label for _, label in self.pairs)

    def label(self, column: Column) -> Column:
        """Look the code up in a literal map; unlisted codes become NULL."""
        lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(self.pairs)])
        return F.try_element_at(lookup, column)
