"""Classification trees: single splits, growth and the node table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.models.design import Term, by_class
from surveyloom.models.growing import MAX_DEPTH, Limits, Splits, grow_trees
from surveyloom.operators.running import running_totals

MIN_BUCKET = 7   # fewest rows in a leaf
MIN_SPLIT = 20   # fewest rows in a node that is split
CLASSES = ("No", "Yes")


def best_splits(df: DataFrame, column: str, positive: Column) -> DataFrame:
    """Gini impurity on both sides and the gain of every split of a numeric column."""
    counted = (df.where(F.col(column).isNotNull() & positive.isNotNull())
               .groupBy(F.col(column).cast("double").alias("value"))
               .agg(F.count("*").alias("n"), F.count_if(positive).alias("pos")))
    ranked = running_totals(counted, [], "value", ["n", "pos"]).where("next_value is not null")

    def gini(share: Column) -> Column:
        return 2 * share * (1 - share)

    n, left, pos, pos_left = (F.col(c) for c in ("n_all", "n_run", "pos_all", "pos_run"))
    right = n - left
    gini_left, gini_right = gini(pos_left / left), gini((pos - pos_left) / right)
    return ranked.select(((F.col("value") + F.col("next_value")) / 2).alias("split"),
                         gini_left.alias("gini_left"), gini_right.alias("gini_right"),
                         (gini(pos / n) - (left * gini_left + right * gini_right) / n).alias("gain"))


@dataclass(frozen=True)
class Node:
    """One node in preorder; ``left_set`` holds level positions, ``threshold`` a number."""

    id: int
    left: int
    right: int
    counts: tuple[float, float]
    term: int
    threshold: float | None
    left_set: tuple[int, ...]

    @property
    def is_leaf(self) -> bool:
        return self.left < 0

    @property
    def n(self) -> float:
        return sum(self.counts)

    @property
    def prediction(self) -> int:
        return int(self.counts[1] > self.counts[0])

    @property
    def loss(self) -> float:
        """Rows of the node that are not of its majority class."""
        return min(self.counts)

    @property
    def gini_total(self) -> float:
        return 2 * self.counts[0] * self.counts[1] / self.n if self.n else 0.0


@dataclass(frozen=True)
class Tree:
    terms: tuple[Term, ...]
    splits: Splits

    @cached_property
    def nodes(self) -> dict[int, Node]:
        s = self.splits
        return {i: Node(i, int(s.left[i]), int(s.right[i]), (float(s.counts[i, 0]), float(s.counts[i, 1])), int(s.term[i]),
                        None if np.isnan(s.threshold[i]) else float(s.threshold[i]), tuple(np.flatnonzero(s.goes_left[i]).tolist()))
                for i in range(len(s.term))}


def grow_tree(patterns: DataFrame, terms: Sequence[Term], max_depth: int = MAX_DEPTH,
              min_bucket: int = MIN_BUCKET, min_split: int = MIN_SPLIT) -> Tree:
    """Grow a tree to its limits on weighted answer patterns.

    ``min_bucket`` and ``min_split`` count rows and not patterns.  Every split of a
    number and the best grouping of levels are tried, and the first of equal ones taken.
    """
    (grown,) = grow_trees(by_class(patterns), terms, F.array("weight"), 1, Limits(max_depth, min_bucket, min_split))
    return Tree(tuple(terms), grown)
