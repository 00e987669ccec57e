"""Fitted models as tables, which outlast the session, and scores read off those tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.models.design import Term
from surveyloom.models.forest import Forest
from surveyloom.models.growing import Splits, placed
from surveyloom.models.logit import INTERCEPT, Logit
from surveyloom.models.trees import CLASSES
from surveyloom.sources.scratch import settle

NODES = ("tree int, node int, left int, right int, term string, threshold double, levels array<string>, no double, yes double, "
         "class string")


def _node_columns(number: int, tree: Splits, terms: Sequence[Term]) -> list:
    names = np.array([t.name for t in terms] + [None], dtype=object)
    factor = np.array([t.is_factor for t in terms] + [False])
    size, inner = len(tree.term), tree.term >= 0
    sides = [np.where(inner, side, None).tolist() for side in (tree.left, tree.right)]
    levels = [[terms[j].levels[k] for k in np.flatnonzero(tree.goes_left[i])] if factor[j] else None
              for i, j in enumerate(tree.term.tolist())]
    threshold = np.where(np.isnan(tree.threshold), None, tree.threshold).tolist()
    return [[number] * size, range(size), *sides, names[tree.term].tolist(), threshold, levels, tree.counts[:, 0].tolist(),
            tree.counts[:, 1].tolist(), np.array(CLASSES)[tree.labels].tolist()]


def node_rows(spark: SparkSession, trees: Sequence[Splits], terms: Sequence[Term]) -> DataFrame:
    """One row per node of every tree: children, the term and the answers or numbers that go left, rows of both classes."""
    columns: list[list] = [[] for _ in NODES.split(", ")]
    for number, tree in enumerate(trees):
        for column, values in zip(columns, _node_columns(number, tree, terms), strict=True):
            column.extend(values)
    shape = spark.createDataFrame([], NODES).toArrow().schema
    return spark.createDataFrame(pa.table([pa.array(v, f.type) for v, f in zip(columns, shape)], schema=shape))


def forest_node_rows(forest: Forest) -> DataFrame:
    """``node_rows`` of a forest, listed in tasks, a tree at a time."""
    shape = forest.packed.sparkSession.createDataFrame([], NODES).toArrow().schema
    terms = forest.terms

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                columns = _node_columns(row["tree"], Splits.unpacked(row), terms)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, shape)], schema=shape)

    return forest.packed.drop("saved").repartition(forest.count, "tree").mapInArrow(listed, NODES)


def read_trees(nodes: DataFrame, terms: Sequence[Term]) -> list[Splits]:
    """The trees of a node table, for scoring in tasks; as many rows as the model has nodes."""
    place = {t.name: j for j, t in enumerate(terms)}
    width = max([len(t.levels) for t in terms] + [1])
    trees = []
    by_tree: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").collect():
        by_tree.setdefault(r.tree, []).append(r)
    for rows in by_tree.values():
        goes_left = np.zeros((len(rows), width), bool)
        for i, r in enumerate(rows):
            if r.levels is not None:
                goes_left[i, [terms[place[r.term]].levels.index(x) for x in r.levels]] = True
        trees.append(Splits(np.array([-1 if r.term is None else place[r.term] for r in rows]),
                            np.array([np.nan if r.threshold is None else r.threshold for r in rows]), goes_left,
                            np.array([-1 if r.left is None else r.left for r in rows]),
                            np.array([-1 if r.right is None else r.right for r in rows]), np.array([(r.no, r.yes) for r in rows])))
    return trees


def score_by_nodes(df: DataFrame, nodes: DataFrame, terms: Sequence[Term], id_column: str) -> DataFrame:
    """``id_column, tree, class`` of every complete row by every tree, joined with the node table depth by depth.

    The table may hold any number of trees; the planner broadcasts it or shuffles
    both sides by its size.  Rows with a missing or undeclared answer are left out.
    """
    answers = F.create_map(*[x for t in terms for x in (F.lit(t.name), F.col(t.name).cast("string"))])
    numbers = F.create_map(*[x for t, column in zip(terms, placed(terms)) for x in (F.lit(t.name), column)])
    usable = df
    for term in terms:
        usable = usable.where(term.usable())
    last = nodes.agg(F.max("tree")).first()[0]
    rows = usable.select(F.col(id_column).alias("row"), answers.alias("answers"), numbers.alias("numbers"))
    at = settle(rows.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(last))), "node": F.lit(0)}))
    done = None
    while True:
        met = at.join(nodes.drop("no", "yes"), ["tree", "node"])
        ended = settle(met.where("term is null").select("row", "tree", "class"))
        done = ended if done is None else done.unionByName(ended)
        left = F.when(F.col("threshold").isNotNull(), F.col("numbers")[F.col("term")] <= F.col("threshold")).otherwise(
            F.array_contains("levels", F.col("answers")[F.col("term")]))
        at = settle(met.where("term is not null").select(
            "row", "answers", "numbers", "tree", F.when(left, F.col("left")).otherwise(F.col("right")).alias("node")))
        if at.isEmpty():
            return done.withColumnRenamed("row", id_column)


def coefficient_rows(spark: SparkSession, fit: Logit) -> DataFrame:
    """``term, level, estimate, std_error``: the level is missing for numbers, the term for the intercept."""
    rows = [(None, None, fit.estimates[INTERCEPT], fit.errors[INTERCEPT])]
    for term in fit.terms:
        for name, level in zip(term.contrast_names(), term.levels[1:] or (None,)):
            if name in fit.estimates:
                rows.append((term.name, level, fit.estimates[name], fit.errors[name]))
    return spark.createDataFrame(rows, "term string, level string, estimate double, std_error double")


def probability_from(coefficients: DataFrame, terms: Sequence[Term]) -> Column:
    """P(positive) by a coefficient table; missing where an answer is missing or not declared."""
    total = F.lit(0.0)
    for r in coefficients.collect():  # as many rows as the model has coefficients
        if r.term is None:
            total = total + F.lit(r.estimate)
        elif r.level is None:
            total = total + F.col(r.term).cast("double") * F.lit(r.estimate)
        else:
            total = total + (F.col(r.term).cast("string") == r.level).cast("double") * F.lit(r.estimate)
    usable = F.lit(True)
    for term in terms:
        usable = usable & term.usable()
    return F.when(usable, 1 / (1 + F.exp(-total)))
