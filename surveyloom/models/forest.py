"""Random forests, out-of-bag errors and permutation importance.

The bootstrap, the folds and the permutation are hashes of the row id, so they
can be looked up again and do not depend on partitions or cores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.models.design import Term, complete_rows, uniform
from surveyloom.models.growing import MAX_DEPTH, Limits, Splits, dealt_out, packed_trees, placed, unpacked_all
from surveyloom.models.trees import CLASSES
from surveyloom.sources.scratch import settle

STABLE_TREES = 150      # the out-of-bag error no longer falls beyond this
SHUFFLE_BLOCK = 100_000
NEVER_DRAWN = math.exp(-1)
EPSILON = 2.0 ** -52
MOST_DRAWS = 12
# Rows of a slice, and nodes of a group of trees, that one task holds; parts into which the votes of a slice are cut.
SLICE_ROWS = 500_000
GROUP_NODES = 3_000_000
SLICE_PARTS = 16
# Pairs of a slice and a group from which on all tasks are busy.
LEAST_PAIRS = 36


def labelled_rows(df: DataFrame, terms: Sequence[Term], response: str, positive: str, id_column: str) -> DataFrame:
    """Complete rows with the 0/1 response ``y`` and the row id ``row_id``."""
    return complete_rows(df, terms, response).select(
        F.col(id_column).alias("row_id"), (F.col(response) == positive).cast("double").alias("y"),
        *[F.col(t.name) for t in terms])


# ---- bootstrap

def draws(trees: int, seed: int) -> Column:
    """For every tree the number that decides how often the row is drawn."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: uniform("row_id", F.lit(seed), t))


def times_drawn(number: Column) -> Column:
    """Poisson(1) quantile: how often a row is drawn for a tree."""
    chance, reached, times = NEVER_DRAWN, 0.0, None
    for k in range(MOST_DRAWS):
        reached += chance
        chance /= k + 1
        times = F.when(number < reached, k) if times is None else times.when(number < reached, k)
    return times.otherwise(MOST_DRAWS).cast("double")


# ---- growth

@dataclass(frozen=True)
class Forest:
    """``packed`` is a written table with one row per tree; none of its nodes need be on the driver."""

    packed: DataFrame
    count: int
    terms: tuple[Term, ...]
    seed: int

    @cached_property
    def trees(self) -> tuple[Splits, ...]:
        """All trees on the driver, for small forests."""
        return tuple(unpacked_all(self.packed))


def fit_forest(rows: DataFrame, terms: Sequence[Term], trees: int = STABLE_TREES, max_depth: int = MAX_DEPTH,
               seed: int = 200) -> Forest:
    """Trees grown out on bootstraps of all rows, with a sample of floor(sqrt(terms)) terms at each split.

    Every row has a weight for each tree; the trees grow together.
    """
    limits = Limits(max_depth, at_split=max(1, math.isqrt(len(terms))), seed=seed)
    grown = packed_trees(rows, terms, F.transform(draws(trees, seed), times_drawn), trees, limits)
    return Forest(grown, trees, tuple(terms), seed)


def _groups(forest: Forest, slices: int) -> list[list[int]]:
    """The trees in order, cut into groups of few nodes, and into enough of them to keep all tasks busy."""
    most = max(1, forest.count * slices // LEAST_PAIRS)
    groups, nodes = [], 0
    for r in forest.packed.select("tree", "nodes").orderBy("tree").collect():  # one row per tree
        if not groups or len(groups[-1]) >= most or nodes + r.nodes > GROUP_NODES:
            groups.append([])
            nodes = 0
        groups[-1].append(r.tree)
        nodes += r.nodes
    return groups


def _meet(rows: DataFrame, forest: Forest, unseen: bool, work: Callable[[pd.DataFrame, list[tuple[int, Splits]]], pd.DataFrame],
          schema: str) -> DataFrame:
    """``work`` on every slice of the rows with every group of trees.

    ``rows`` get a ``number`` and the ``part`` of their slice they belong to; with
    ``unseen`` also, for every tree of the group, whether it has not drawn the row.
    Rows and trees are shuffled to where they meet, so neither has to fit one machine.
    """
    rows = settle(rows.withColumn("number", F.monotonically_increasing_id()))
    count = rows.count()
    slices = max(1, math.ceil(count / SLICE_ROWS))
    groups = _groups(forest, slices)
    part = F.pmod(F.xxhash64("number"), F.lit(slices * SLICE_PARTS)).cast("int")
    many = dealt_out(rows, count).withColumns({"part": part, "slice": F.pmod(part, F.lit(slices)),
                             "first": F.explode(F.array(*[F.lit(g[0]) for g in groups]))})
    if unseen:
        last = F.create_map(*[F.lit(x) for g in groups for x in (g[0], g[-1])])[F.col("first")]
        many = many.withColumn("unseen", F.transform(F.sequence(F.col("first"), last),
                                                     lambda t: uniform("row_id", F.lit(forest.seed), t) < NEVER_DRAWN))
    many = many.drop("row_id") if unseen else many
    first = F.create_map(*[F.lit(x) for g in groups for t in g for x in (t, g[0])])[F.col("tree")]
    trees = forest.packed.drop("counts", "saved").withColumns(
        {"first": first, "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})

    def pair(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values("tree")
        return work(mine.sort_values("number"), [(int(t["tree"]), Splits.unpacked(t)) for t in theirs.to_dict("records")])

    many, trees = (side.repartition(slices * len(groups), "slice", "first") for side in (many, trees))
    return many.groupBy("slice", "first").cogroup(trees.groupBy("slice", "first")).applyInPandas(pair, schema)


def predict_forest(rows: DataFrame, forest: Forest) -> DataFrame:
    """``row_id, actual, predicted`` by majority vote of all trees; a tie is ``No``."""
    kind = rows.schema["row_id"].dataType.simpleString()
    places = [f"p{i}" for i in range(len(forest.terms))]

    def votes(mine: pd.DataFrame, trees: list[tuple[int, Splits]]) -> pd.DataFrame:
        values = mine[places].to_numpy(np.float64)
        yes = sum((tree.classes(values) for _, tree in trees), np.zeros(len(mine), np.int64))
        return mine[["number", "row_id", "y"]].assign(yes=yes)

    voted = _meet(rows.select("row_id", "y", *placed(forest.terms)), forest, False, votes,
                  f"number long, row_id {kind}, y double, yes long")
    classes = F.array(*map(F.lit, CLASSES))
    return (voted.groupBy("number", "row_id", "y").agg(F.sum("yes").alias("yes"))
            .select("row_id", F.element_at(classes, F.col("y").cast("int") + 1).alias("actual"),
                    F.element_at(classes, (2 * F.col("yes") > forest.count).cast("int") + 1).alias("predicted")))


def oob_curve(rows: DataFrame, forest: Forest) -> DataFrame:
    """Out-of-bag confusion after 1, 2, ... trees: ``trees, actual, predicted, n``.

    A row is voted on by the trees that have not drawn it.  The votes of a part of
    the rows come together from all groups of trees and are reduced to four counts
    per number of trees.
    """
    places, count = [f"p{i}" for i in range(len(forest.terms))], forest.count

    def votes(mine: pd.DataFrame, trees: list[tuple[int, Splits]]) -> pd.DataFrame:
        said = np.zeros((len(mine), len(trees)), np.int8)  # 0 for a row that the tree has drawn
        if len(mine):
            values, unseen = mine[places].to_numpy(np.float64), np.stack(mine["unseen"].to_numpy())
            for i, (_, tree) in enumerate(trees):
                asked = np.flatnonzero(unseen[:, i])
                said[asked, i] = 1 + tree.classes(values[asked])
        part, y = mine["part"].to_numpy(), mine["y"].to_numpy() == 1
        each = [part == p for p in np.unique(part)]
        return pd.DataFrame({"part": np.unique(part), "first": trees[0][0], "y": [y[own].tobytes() for own in each],
                             "said": [said[own].tobytes() for own in each]})

    def judge(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("first")
        actual = np.frombuffer(mine["y"].iloc[0], bool)
        said = np.hstack([np.frombuffer(x, np.int8).reshape(len(actual), -1) for x in mine["said"]])
        lead, voted = np.cumsum(np.where(said, 2 * said - 3, 0), axis=1, dtype=np.int32), np.logical_or.accumulate(said > 0, axis=1)
        cells = np.array([[(voted & (actual == bool(a))[:, None] & ((lead > 0) == bool(p))).sum(axis=0) for p in (0, 1)] for a in (0, 1)])
        a, p, tree = np.indices(cells.shape)
        return pd.DataFrame({"trees": tree.ravel() + 1, "a": a.ravel(), "p": p.ravel(), "n": cells.ravel()})

    classes = F.array(*map(F.lit, CLASSES))
    cast = _meet(rows.select("row_id", "y", *placed(forest.terms)), forest, True, votes, "part int, first int, y binary, said binary")
    none = (rows.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("trees"), F.explode(F.array(F.lit(0), F.lit(1))).alias("a"))
            .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("p"), F.lit(0).cast("long").alias("n")))
    return (cast.groupBy("part").applyInPandas(judge, "trees int, a int, p int, n bigint").unionByName(none)
            .groupBy("trees", "a", "p").agg(F.sum("n").alias("n"))
            .select("trees", F.element_at(classes, F.col("a") + 1).alias("actual"),
                    F.element_at(classes, F.col("p") + 1).alias("predicted"), "n"))


def curve_errors(curve: DataFrame) -> DataFrame:
    """Out-of-bag error overall and per class against the number of trees."""
    wrong = F.col("actual") != F.col("predicted")

    def error(among: Column) -> Column:
        return F.try_divide(F.sum(F.when(among & wrong, F.col("n")).otherwise(0)),
                            F.sum(F.when(among, F.col("n")).otherwise(0)))

    return curve.groupBy("trees").agg(
        error(F.lit(True)).alias("oob"), error(F.col("actual") == CLASSES[0]).alias("error_no"),
        error(F.col("actual") == CLASSES[1]).alias("error_yes"), F.sum("n").alias("n_rows"))


# ---- permutation importance

def shuffled_neighbours(rows: DataFrame, columns: Sequence[str], seed: int,
                        block_rows: int = SHUFFLE_BLOCK) -> DataFrame:
    """Add a struct ``swap`` with the column values of another, random row.

    Each row takes the values of the one before it in the random order of a hash
    of the id, the first those of the last.  Every value is used exactly once, so
    each column is truly permuted; one shuffle serves all columns.  The order is
    cut into stretches of some ``block_rows`` rows, which shows in nothing.
    """
    blocks = max(1, math.ceil(rows.count() / block_rows))
    key = F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.lit(str(seed)), F.lit("order")))
    laid_out = rows.withColumns({
        "_block": F.floor(uniform("row_id", F.lit(seed), F.lit("order")) * blocks),  # the first digits of the key
        "_place": F.struct(key, "row_id", F.struct(*rows.columns)), "_own": F.struct(*columns)})
    last = settle(laid_out.groupBy("_block").agg(F.max_by("_own", "_place").alias("_last")))
    stretches = Window.orderBy("_block")
    whole = stretches.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = last.select("_block", F.coalesce(F.lag("_last").over(stretches), F.last("_last").over(whole)).alias("_before"))  # one row per stretch
    order = Window.partitionBy("_block").orderBy("_place")
    return (laid_out.withColumn("swap", F.lag("_own").over(order)).join(before, "_block")
            .withColumn("swap", F.coalesce("swap", "_before")).drop("_block", "_place", "_own", "_before"))


def _drops(rows: DataFrame, forest: Forest, seed: int, block_rows: int) -> DataFrame:
    """``tree, term, class, lost, asked``: right votes that each tree loses, of the rows of a class that it has not drawn.

    A row is walked down a tree once.  With the values of another row for one term
    it can only end elsewhere if its way looked at that term, and then goes on from there.
    """
    terms = forest.terms
    swapped = shuffled_neighbours(rows, [t.name for t in terms], seed, block_rows)
    own = swapped.select("row_id", "y", "swap", *placed(terms, "own"))
    both = own.select("row_id", "y", *[f"own{i}" for i in range(len(terms))], "swap.*").select(
        "row_id", "y", *[f"own{i}" for i in range(len(terms))], *placed(terms, "new"))

    def hits(mine: pd.DataFrame, trees: list[tuple[int, Splits]]) -> pd.DataFrame:
        asked, lost = np.zeros((len(trees), 2), "int64"), np.zeros((len(trees), len(terms), 2), "int64")
        if len(mine):
            y = mine["y"].to_numpy().astype(int)
            values = mine[[f"own{i}" for i in range(len(terms))]].to_numpy(np.float64)
            other = mine[[f"new{i}" for i in range(len(terms))]].to_numpy(np.float64)
            unseen = np.stack(mine["unseen"].to_numpy())
            for i, (_, tree) in enumerate(trees):
                out = np.flatnonzero(unseen[:, i])
                asked[i] += np.bincount(y[out], minlength=2)
                tested = np.full((len(out), len(terms)), -1)
                said = tree.labels[tree.leaves(values[out], tested=tested)]
                for j in np.flatnonzero((tested >= 0).any(axis=0)):
                    moved = np.flatnonzero((tested[:, j] >= 0) & (values[out, j] != other[out, j]))
                    changed = values[out[moved]]
                    changed[:, j] = other[out[moved], j]
                    now = tree.labels[tree.leaves(changed, tested[moved, j])]
                    truth = y[out[moved]]
                    lost[i, j] += np.bincount(truth, (said[moved] == truth).astype(int) - (now == truth), 2).astype(int)
        tree, term, label = np.indices(lost.shape)
        return pd.DataFrame({"tree": np.array([number for number, _ in trees])[tree.ravel()], "term": term.ravel(), "class": label.ravel(),
                             "lost": lost.ravel(), "asked": np.repeat(asked[:, None], len(terms), axis=1).ravel()})

    return _meet(both, forest, True, hits, "tree int, term int, class int, lost bigint, asked bigint").groupBy(
        "tree", "term", "class").agg(F.sum("lost").alias("lost"), F.sum("asked").alias("asked"))


def permutation_importance(rows: DataFrame, forest: Forest, seed: int = 200,
                           block_rows: int = SHUFFLE_BLOCK) -> DataFrame:
    """Mean over the trees of the drop in out-of-bag accuracy when one term takes the values of other rows.

    Every tree is asked only about rows it has not drawn.  Each task reduces its
    rows to hits per tree and term; a tree that has drawn every row has no say.
    """
    table = importance_table(rows, forest, seed, block_rows)
    return table.select("term", F.col("drop").alias("importance"))


def importance_table(rows: DataFrame, forest: Forest, seed: int = 200, block_rows: int = SHUFFLE_BLOCK) -> DataFrame:
    """Importance of every term by four measures, and the plain mean drop in accuracy.

    ``accuracy`` is the mean drop in out-of-bag accuracy per tree divided by its
    standard error over the trees; ``no`` and ``yes`` are the same among rows of one
    class; where the drops do not vary the mean itself stands.  ``gini`` is the
    impurity that the splits on the term save, added up over the nodes of a tree, mean over the trees.
    """
    trees = forest.count
    saved = np.mean([r.saved for r in forest.packed.select("tree", "saved").orderBy("tree").collect()], axis=0)  # one row per tree
    drops = _drops(rows, forest, seed, block_rows)

    def of(name: str, label: Column | None = None) -> list[Column]:
        mine = F.lit(True) if label is None else label
        return [F.try_divide(F.sum(F.when(mine, F.col("lost")).otherwise(0)), F.sum(F.when(mine, F.col("asked")).otherwise(0))).alias(name)]

    per_tree = drops.groupBy("tree", "term").agg(*of("drop"), *of("no", F.col("class") == 0), *of("yes", F.col("class") == 1))

    def scaled(name: str) -> Column:
        mean = F.avg(name)
        error = F.sqrt(F.greatest(F.avg(F.col(name) * F.col(name)) - mean * mean, F.lit(0.0)) / trees)
        return F.when(error < EPSILON, mean).otherwise(mean / error)

    names = F.array(*[F.lit(t.name) for t in forest.terms])
    gini = F.array(*[F.lit(float(x)) for x in saved])
    return per_tree.groupBy("term").agg(F.avg("drop").alias("drop"), scaled("no").alias("no"), scaled("yes").alias("yes"),
                                        scaled("drop").alias("accuracy")).select(
        F.element_at(names, F.col("term") + 1).alias("term"), "drop", "no", "yes", "accuracy",
        F.element_at(gini, F.col("term") + 1).alias("gini"))
