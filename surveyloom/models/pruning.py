"""Cost-complexity pruning of a grown tree.

The node list of a tree is part of the fitted model and lives on the driver.
Rows are only ever sent to leaves by Spark, and come back as counts per leaf.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction
from functools import cached_property, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.models.design import Term, by_class, uniform
from surveyloom.models.growing import MAX_DEPTH, Limits, grow_trees, placed
from surveyloom.models.trees import CLASSES, MIN_BUCKET, MIN_SPLIT, Node, Tree
from surveyloom.operators.joins import scalars

FOLDS = 10


def preorder(nodes: dict[int, Node], is_leaf: Callable[[Node], bool], start: int = 0) -> Iterator[Node]:
    stack = [start]
    while stack:
        node = nodes[stack.pop()]
        yield node
        if not is_leaf(node):
            stack += [node.right, node.left]


def _exact(loss: float) -> int | Fraction:
    return int(loss) if float(loss).is_integer() else Fraction(loss)


def link_strengths(tree: Tree) -> dict[int, Fraction]:
    """For each inner node, the penalty per leaf at which it is collapsed, as an exact ratio.

    Weakest links go first: the node whose branch saves the least loss per
    extra leaf.  A node never goes later than one above it.  Losses are counts of
    rows, so the ratios are those of whole numbers and equal ones are equal.

    Seen from below, a node goes where its loss as a leaf meets that of its branch
    pruned at the same penalty.  Nodes below that go later by themselves go with
    it and are dropped for good, so each is taken from its queue once.
    """
    left, right = tree.splits.left.tolist(), tree.splits.right.tolist()
    own = [_exact(loss) for loss in tree.splits.counts.min(axis=1).tolist()]

    # The quotient of two whole numbers is rounded once, so equal ratios give equal numbers; different ones do
    # too only where their products pass 2 ** 52, and are then compared as ratios.
    small = own[0] * (len(own) + 1) // 2 < 2 ** 52 and all(isinstance(x, int) for x in own)

    def strength(saved: int | Fraction, extra: int) -> float | Fraction:
        return saved / extra if small else Fraction(saved) / extra

    # For each node, the nodes below that go before it: strength (largest first), loss gained, leaves removed.
    queues: dict[int, list[tuple]] = {}
    goes: dict[int, tuple] = {}
    for i in range(len(own) - 1, -1, -1):  # children come after their parents
        if left[i] < 0:
            continue
        queue, other = sorted((queues.pop(left[i], []), queues.pop(right[i], [])), key=len, reverse=True)
        for event in other:
            heapq.heappush(queue, event)
        saved, extra = own[i] - own[left[i]] - own[right[i]], 1
        value = strength(saved, extra)
        while queue and -queue[0][0] > value:
            _, gained, removed = heapq.heappop(queue)
            saved, extra = saved + gained, extra + removed
            value = strength(saved, extra)
        heapq.heappush(queue, (-value, saved, extra))
        queues[i] = queue
        goes[i] = value, saved, extra

    collapsed: dict[int, Fraction] = {}
    reached: dict[int, float | Fraction] = {}
    for i in sorted(goes):
        value, saved, extra = goes[i]
        if i in reached and reached[i] <= value:
            value = reached[i]
        else:
            collapsed[i] = Fraction(saved) / extra
        for child in (left[i], right[i]):
            if child in goes:
                reached[child], collapsed[child] = value, collapsed[i]
    return collapsed


def shares_of_root(tree: Tree, strengths: dict[int, Fraction]) -> dict[int, float]:
    """The strengths as complexity parameters, each rounded once: a cp read from a table finds its own nodes."""
    root = _exact(tree.splits.counts[0].min().item())
    return {i: float(strength / root) if root else 0.0 for i, strength in strengths.items()}


def loss_by_penalty(tree: Tree, strengths: dict[int, float | Fraction],
                    loss: Sequence[float]) -> Callable[[float], tuple[int, float]]:
    """Splits and total loss of the pruning at any penalty, given the loss of each node as a leaf.

    A node is split exactly if its strength exceeds the penalty, so the
    answer is a running sum over the strengths in falling order.
    """
    left, right = tree.splits.left.tolist(), tree.splits.right.tolist()
    nodes: dict[float | Fraction, int] = {}
    saved: dict[float | Fraction, float] = {}
    for i, strength in strengths.items():
        nodes[strength] = nodes.get(strength, 0) + 1
        saved[strength] = saved.get(strength, 0.0) + (loss[i] - loss[left[i]] - loss[right[i]])
    order = sorted(nodes, reverse=True)
    falling = [-strength for strength in order]
    splits = list(accumulate((nodes[x] for x in order), initial=0))
    less = list(accumulate((saved[x] for x in order), initial=0.0))

    def at(penalty: float) -> tuple[int, float]:
        reached = bisect_left(falling, -penalty)
        return splits[reached], loss[0] - less[reached]
    return at


@dataclass(frozen=True)
class Pruned:
    """A tree whose nodes with a complexity parameter up to ``cp`` are leaves."""

    tree: Tree
    strengths: dict[int, Fraction]
    cp: float

    @cached_property
    def split_nodes(self) -> set[int]:
        return {i for i, share in shares_of_root(self.tree, self.strengths).items() if share > self.cp}

    def is_leaf(self, node: Node) -> bool:
        return node.id not in self.split_nodes

    def nodes(self) -> list[Node]:
        return list(preorder(self.tree.nodes, self.is_leaf))

    @property
    def splits(self) -> int:
        return sum(not self.is_leaf(n) for n in self.nodes())

    @property
    def loss(self) -> float:
        return sum(n.loss for n in self.nodes() if self.is_leaf(n))


def prune(tree: Tree, cp: float, strengths: dict[int, Fraction] | None = None) -> Pruned:
    """Prune to a strength given as a share of the root's loss."""
    return Pruned(tree, link_strengths(tree) if strengths is None else strengths, cp)


def predict_class(df: DataFrame, pruned: Pruned, target: str = "predicted") -> DataFrame:
    """Add the class by the rules of the pruned tree.

    A row with a missing answer or one that is not a declared level has a missing
    class.  Batches of rows walk the tree as arrays, so the plan stays the same
    for any number of splits.
    """
    terms, whole = pruned.tree.terms, pruned.tree.splits
    kept = np.zeros(len(whole.term), bool)
    kept[list(pruned.split_nodes)] = True
    splits = replace(whole, term=np.where(kept, whole.term, -1))

    @F.pandas_udf("string")
    def said(answers: pd.DataFrame) -> pd.Series:
        return pd.Series(np.array(CLASSES, dtype=object)[splits.classes(answers.to_numpy(np.float64))])

    usable = reduce(Column.__and__, [F.coalesce(term.usable(), F.lit(False)) for term in terms])
    # Answers that are not usable have some place on the way, and no class at its end.
    answers = F.struct(*[F.coalesce(place, F.lit(0.0)).alias(f"p{i}") for i, place in enumerate(placed(terms))])
    return df.withColumn(target, F.when(usable, said(answers)))


# ---- complexity table

def cp_rows(tree: Tree, strengths: dict[int, Fraction]) -> list[tuple[float, int, float]]:
    """``cp, nsplit, rel_error`` from the bare root to the full tree, cp falling to 0."""
    root = tree.splits.counts[0].min().item()
    if not root:
        return [(0.0, 0, 1.0)]
    shares = shares_of_root(tree, strengths)
    at = loss_by_penalty(tree, shares, tree.splits.counts.min(axis=1).tolist())
    cps = [*sorted({share for share in shares.values() if share > 0}, reverse=True), 0.0]
    return [(cp, splits, loss / root) for cp, (splits, loss) in ((cp, at(cp)) for cp in cps)]


def fold_of(id_column: str, seed: int, folds: int = FOLDS) -> Column:
    return F.floor(uniform(id_column, F.lit(seed)) * folds).cast("int").alias("fold")


def held_out_counts(patterns: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    """``fold, leaf, y, n``: where the rows of every fold end in the tree grown without them.  One scan for all folds."""
    terms = trees[0].terms
    places, splits = [f"p{i}" for i in range(len(terms))], [tree.splits for tree in trees]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, fold = batch[places].to_numpy(np.float64), batch["fold"].to_numpy()
            leaf = np.zeros(len(batch), np.int64)
            for f in np.unique(fold):
                leaf[fold == f] = splits[f].leaves(values[fold == f])
            yield batch[["fold", "y", "weight"]].assign(leaf=leaf).groupby(["fold", "leaf", "y"], as_index=False)["weight"].sum()

    rows = by_class(patterns).select("fold", "y", "weight", *placed(terms))
    return (rows.mapInPandas(work, "fold int, leaf int, y double, weight double")
            .groupBy("fold", "leaf", "y").agg(F.sum("weight").alias("n")))


def errors_of(tree: Tree, strengths: dict[int, Fraction], penalties: Sequence[float], counts: pd.DataFrame) -> list[float]:
    """Wrong predictions on other rows, given as counts ``n`` per ``leaf`` and class ``y``, at each penalty."""
    splits = tree.splits
    left, right, labels = splits.left.tolist(), splits.right.tolist(), splits.labels.tolist()
    place = 2 * counts["leaf"].to_numpy(np.int64) + counts["y"].to_numpy(np.float64).astype(np.int64)
    seen = np.bincount(place, counts["n"].to_numpy(np.float64), 2 * len(left)).reshape(-1, 2).tolist()
    for i in range(len(left) - 1, -1, -1):  # children come after their parents
        if left[i] >= 0:
            seen[i] = [a + b for a, b in zip(seen[left[i]], seen[right[i]])]
    at = loss_by_penalty(tree, strengths, [both[1 - label] for both, label in zip(seen, labels)])
    return [at(penalty)[1] for penalty in penalties]


def held_out_errors(patterns: DataFrame, trees: Sequence[Tree], penalties: Sequence[Sequence[float]]) -> list[list[float]]:
    """By fold, the wrong predictions on its rows by the tree grown without them, at each of its penalties.

    Every fold prunes its tree in a task of its own; the driver gets as many numbers as there are penalties.
    """
    def judge(mine: pd.DataFrame) -> pd.DataFrame:
        fold = int(mine["fold"].iloc[0])
        errors = errors_of(trees[fold], link_strengths(trees[fold]), penalties[fold], mine)
        return pd.DataFrame({"fold": [fold], "errors": [errors]})

    counts = held_out_counts(patterns, trees).repartition(len(trees), "fold")  # a number that is given is not lowered
    found = counts.groupBy("fold").applyInPandas(judge, "fold int, errors array<double>").toArrow()
    errors = [[0.0] * len(each) for each in penalties]  # of folds without rows
    for fold, each in zip(found.column("fold").to_pylist(), found.column("errors")):
        errors[fold] = each.values.to_pylist()
    return errors


def cp_table(patterns: DataFrame, terms: Sequence[Term], folds: int = FOLDS, max_depth: int = MAX_DEPTH,
             min_bucket: int = MIN_BUCKET, min_split: int = MIN_SPLIT) -> tuple[Tree, list[tuple]]:
    """Grow a tree and cross-validate its prunings.

    ``patterns`` carry a ``fold`` column.  Returns the tree and rows
    ``cp, nsplit, rel_error, xerror, xstd``.  The tree and those without one fold
    each are grown together.  The held-out rows of a fold meet its tree as counts per
    leaf, from which the errors of all prunings follow; a task does that for a fold.
    """
    each = [F.when(F.col("fold") == fold, 0.0).otherwise(F.col("weight")) for fold in range(folds)]
    *parts, tree = [Tree(tuple(terms), grown) for grown in grow_trees(
        by_class(patterns), terms, F.array(*each, "weight"), folds + 1, Limits(max_depth, min_bucket, min_split))]
    rows = cp_rows(tree, link_strengths(tree))
    total, root = tree.splits.counts[0].sum().item(), tree.splits.counts[0].min().item()
    cps = [cp for cp, _, _ in rows]
    # A pruning holds between its own cp and the one above: test halfway.
    betas = [math.inf if i == 0 else math.sqrt(cps[i] * cps[i - 1]) for i in range(len(cps))]
    scales = [root * part.splits.counts[0].sum().item() / total if total else 0.0 for part in parts]
    errors = held_out_errors(patterns, parts, [[beta * scale for beta in betas] for scale in scales])
    wrong = [sum(each) for each in zip(*errors)]
    return tree, [(cp, splits, rel, e / root if root else 0.0, math.sqrt(max(e - e * e / total, 0.0)) / root if root else 0.0)
                  for (cp, splits, rel), e in zip(rows, wrong)]


def cp_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "cp double, nsplit int, rel_error double, xerror double, xstd double")


def select_cp(table: DataFrame) -> DataFrame:
    """Choose the pruning strength from a complexity table.

    The cap is the smallest ``xerror + xstd``; the first row with ``xerror``
    below the cap wins, and the result is the geometric mean of its cp and
    the one before (its own cp if it is the first).  The table has one row
    per pruning of one tree, so ordering it in one task is fine.
    """
    by_cp = Window.orderBy(F.desc("cp"))
    rows = table.withColumns({"i": F.row_number().over(by_cp), "previous": F.lag("cp").over(by_cp),
                              "reach": F.col("xerror") + F.col("xstd")})
    best = rows.agg(F.min("reach").alias("cap"),
                    F.min_by("i", F.struct("reach", "i")).alias("min_index"))
    of_best = scalars(best)
    picked = F.min_by(F.struct("i", "cp", "previous"), "i")
    return (rows.where(F.col("xerror") < of_best["cap"]).agg(picked.alias("p"))
            .select(of_best["min_index"].alias("min_index"), of_best["cap"].alias("cap"),
                    F.col("p.i").alias("optimal_index"),
                    F.coalesce(F.sqrt(F.col("p.cp") * F.col("p.previous")), F.col("p.cp")).alias("cp")))


# ---- listings

def _rule(term: Term, node: Node, goes_left: bool) -> str:
    if node.threshold is not None:
        return f"{term.name} {'<=' if goes_left else '>'} {node.threshold:g}"
    inside = [label for i, label in enumerate(term.levels) if (i in node.left_set) == goes_left]
    return f"{term.name} in {', '.join(inside)}"


def node_table(spark: SparkSession, pruned: Pruned) -> DataFrame:
    """One row per node: rule, size, loss, class and class shares."""
    rules, depth = {0: "root"}, {0: 0}
    rows = []
    for node in pruned.nodes():
        leaf = pruned.is_leaf(node)
        if not leaf:
            term = pruned.tree.terms[node.term]
            for child, goes_left in ((node.left, True), (node.right, False)):
                rules[child], depth[child] = _rule(term, node, goes_left), depth[node.id] + 1
        rows.append((node.id, depth[node.id], rules[node.id], node.n, node.loss, CLASSES[node.prediction],
                     node.counts[0] / node.n, node.counts[1] / node.n, leaf))
    return spark.createDataFrame(rows, "id int, depth int, rule string, n double, loss double, class string, "
                                       "share_no double, share_yes double, is_leaf boolean")


def tree_importance(spark: SparkSession, pruned: Pruned) -> DataFrame:
    """Gini gain of the splits on each term, scaled to add up to one."""
    gain = dict.fromkeys([t.name for t in pruned.tree.terms], 0.0)
    for node in pruned.nodes():
        if not pruned.is_leaf(node):
            left, right = pruned.tree.nodes[node.left], pruned.tree.nodes[node.right]
            gain[pruned.tree.terms[node.term].name] += node.gini_total - left.gini_total - right.gini_total
    total = sum(gain.values())
    return spark.createDataFrame([(name, value / total if total else 0.0) for name, value in gain.items()],
                                 "term string, importance double")
