"""Classification trees grown many at a time: the folds of one tree, or a forest.

Every pattern of answers carries a weight for each tree.  Nodes of many patterns
are split by counts that Spark sums up for all trees together, level by level: a
pass over the patterns walks each down the splits found so far.  Then every
pattern goes once, packed with others, to the tasks that grow out its nodes with
everything below them.  Both find the same splits, so where the one takes over
from the other shows in the time only.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.models.design import Term
from surveyloom.sources.scratch import settle

MAX_DEPTH = 30
# Most patterns of a node that one task grows out.
LOCAL_ROWS = 200_000
# Counts of a depth that are held in one array of all nodes and values; above that only those that occur.
DENSE_CELLS = 1 << 24
# Patterns that are walked down all trees at a time.
BATCH_ROWS = 100_000
# Tasks that nodes are grown out in, at most.
MOST_TASKS = 1_000
# A split must save so much of the impurity of its node; less is rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Limits:
    """When a node is not split, and how many of the terms, drawn at random, are tried (all if None)."""

    max_depth: int = MAX_DEPTH
    min_bucket: float = 1
    min_split: float = 2
    at_split: int | None = None
    seed: int = 200


@dataclass(frozen=True)
class Splits:
    """One tree as arrays in preorder; a leaf has term -1."""

    term: np.ndarray
    threshold: np.ndarray     # of numbers; NaN for factors
    goes_left: np.ndarray     # of factors, by node and level position
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray        # by node and class

    def leaves(self, values: np.ndarray, start: np.ndarray | int = 0, tested: np.ndarray | None = None) -> np.ndarray:
        """The leaf that rows of level positions and numbers reach; ``tested`` receives, by row and term, the first node that looked."""
        at, open_ = np.zeros(len(values), np.int64) + start, np.arange(len(values))
        while len(open_):
            open_ = open_[self.term[at[open_]] >= 0]
            node = at[open_]
            term = self.term[node]
            if tested is not None:
                fresh = tested[open_, term] < 0
                tested[open_[fresh], term[fresh]] = node[fresh]
            value = values[open_, term]
            by_level = np.isnan(self.threshold[node])
            level = np.where(by_level, value, 0).astype(np.int64)
            left = np.where(by_level, self.goes_left[node, level], value <= self.threshold[node])
            at[open_] = np.where(left, self.left[node], self.right[node])
        return at

    def classes(self, values: np.ndarray) -> np.ndarray:
        return self.labels[self.leaves(values)]

    @cached_property
    def labels(self) -> np.ndarray:
        """The majority class of every node; the first on a tie."""
        return (self.counts[:, 1] > self.counts[:, 0]).astype(np.int64)

    def gini_saved(self, terms: int) -> np.ndarray:
        """Impurity that the splits save, by term."""
        n = self.counts.sum(axis=1)
        impurity = 2 * self.counts[:, 0] * self.counts[:, 1] / np.maximum(n, 1e-300)
        inner = np.flatnonzero(self.term >= 0)
        return np.bincount(self.term[inner], impurity[inner] - impurity[self.left[inner]] - impurity[self.right[inner]], terms)

    def packed(self) -> dict[str, int | bytes]:
        """The arrays as bytes; in preorder the left child is the next node."""
        return {"nodes": len(self.term), "levels": self.goes_left.shape[1], "term": self.term.astype("<i4").tobytes(), "threshold": self.threshold.astype("<f8").tobytes(),
                "goes_left": np.packbits(self.goes_left, axis=1).tobytes(), "right": self.right.astype("<i4").tobytes(),
                "counts": self.counts.astype("<f8").tobytes(), "labels": self.labels.astype("i1").tobytes()}

    @classmethod
    def unpacked(cls, row: Mapping) -> Splits:
        """From ``packed``.  Without counts the classes still hold."""
        nodes = row["nodes"]
        term = np.frombuffer(row["term"], "<i4").astype(np.int64)
        goes_left = np.unpackbits(np.frombuffer(row["goes_left"], np.uint8).reshape(nodes, -1), axis=1,
                                  count=row["levels"]).astype(bool)
        labels = np.frombuffer(row["labels"], "i1").astype(np.int64)
        counts = (np.frombuffer(row["counts"], "<f8").reshape(-1, 2) if "counts" in row else
                  np.stack([1.0 - labels, labels.astype(np.float64)], axis=1))
        return cls(term, np.frombuffer(row["threshold"], "<f8"), goes_left, np.where(term >= 0, np.arange(1, nodes + 1), -1),
                   np.frombuffer(row["right"], "<i4").astype(np.int64), counts)


# ---- splits of many nodes

@dataclass(frozen=True)
class Best:
    """The best splits of several nodes; ``cells`` are all cells in the order in which they were cut."""

    cells: np.ndarray
    node: np.ndarray     # the nodes that are split, in order
    first: np.ndarray    # by split node: places in ``cells`` of the first and the last cell that goes left
    last: np.ndarray


def best_splits(node: np.ndarray, term: np.ndarray, n: np.ndarray, y: np.ndarray, is_factor: np.ndarray, min_bucket: float) -> Best:
    """The best split of every node, given rows and positives per cell: a node, a term and a value, ordered by all three.

    Numbers are cut in order of value, levels in order of their share of positives,
    where the best of all groupings of levels lies.  Of equal splits the first counts.
    """
    place = np.arange(len(node))
    group = np.cumsum((np.diff(node, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
    cells = np.lexsort((np.where(is_factor, y / n, place), group))  # equal ones stay in order
    node, term, n, y = node[cells], term[cells], n[cells], y[cells]
    ends = np.flatnonzero((np.diff(node, append=-1) != 0) | (np.diff(term, append=-1) != 0))
    starts = np.concatenate([[0], ends + 1])[:-1]
    length = ends - starts + 1
    left, hits = np.cumsum(n), np.cumsum(y)
    left -= np.repeat(left[starts] - n[starts], length)
    hits -= np.repeat(hits[starts] - y[starts], length)
    total, positive = np.repeat(left[ends], length), np.repeat(hits[ends], length)
    right, missed = total - left, positive - hits
    fits = (left >= min_bucket) & (right >= min_bucket) & (right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        impurity = np.where(fits, hits * (left - hits) / left + missed * (right - missed) / right, np.inf)
    heads = np.flatnonzero(np.diff(node, prepend=-1))
    least = np.repeat(np.minimum.reduceat(impurity, heads), np.diff(np.append(heads, len(node)))) if len(node) else impurity
    whole = positive * (total - positive) / np.maximum(total, 1e-300)
    hit = np.flatnonzero((impurity == least) & (whole - impurity > LEAST_GAIN * whole))
    chosen, at = np.unique(node[hit], return_index=True)
    last = hit[at]
    return Best(cells, chosen, starts[np.searchsorted(ends, last)], last)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any change over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tried(terms: int, limits: Limits, tree: int, paths: np.ndarray) -> np.ndarray:
    """By node, the terms that are tried, in order; the draw depends on nothing but the place of the node."""
    if limits.at_split is None or limits.at_split >= terms:
        return np.tile(np.arange(terms), (len(paths), 1))
    start = _mixed(np.array([limits.seed, tree], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    own = _mixed(_mixed(paths.astype(np.uint64) ^ start[0]) ^ _mixed(start[1:] + np.uint64(1)))
    number = _mixed(own[:, None] + np.arange(1, terms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.sort(np.argsort(number, axis=1, kind="stable")[:, :limits.at_split], axis=1)


def _depth(path: int) -> int:
    return path.bit_length() - 1


@dataclass(frozen=True)
class Nodes:
    """Nodes of one tree in any order.  The root's path is 1, the children of p are 2p and 2p + 1."""

    path: np.ndarray
    term: np.ndarray
    threshold: np.ndarray
    goes_left: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, parts: Sequence[Nodes], levels: int) -> Nodes:
        """Several together, with one width of the level positions."""
        wide = [np.pad(p.goes_left, ((0, 0), (0, levels - p.goes_left.shape[1]))) for p in parts]
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("path", "term", "threshold")],
                   np.concatenate(wide), np.concatenate([p.counts for p in parts]))

    @classmethod
    def listed(cls, rows: Sequence[tuple], levels: int) -> Nodes:
        """From (path, term, threshold, levels to the left, rows of both classes)."""
        goes_left = np.zeros((len(rows), levels), bool)
        for i, row in enumerate(rows):
            goes_left[i, row[3]] = True
        return cls(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
                   np.array([r[2] for r in rows], np.float64), goes_left, np.array([r[4:6] for r in rows], np.float64).reshape(-1, 2))

    def packed(self, levels: int) -> dict[str, bytes]:
        wide = Nodes.of([self], levels)
        return {"path": wide.path.astype("<i8").tobytes(), "term": wide.term.astype("<i4").tobytes(),
                "threshold": wide.threshold.astype("<f8").tobytes(), "goes_left": np.packbits(wide.goes_left, axis=1).tobytes(),
                "counts": wide.counts.astype("<f8").tobytes()}

    @classmethod
    def unpacked(cls, row: Mapping, levels: int) -> Nodes:
        path = np.frombuffer(row["path"], "<i8")
        goes_left = np.unpackbits(np.frombuffer(row["goes_left"], np.uint8).reshape(len(path), -1), axis=1, count=levels).astype(bool)
        return cls(path, np.frombuffer(row["term"], "<i4").astype(np.int64), np.frombuffer(row["threshold"], "<f8"), goes_left,
                   np.frombuffer(row["counts"], "<f8").reshape(-1, 2))


def _distinct(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """By row and term, the number of a cell; and the values of the cells of each term, which are numbered on."""
    coded, values, width = np.empty((len(columns[0]), len(columns)), np.int64), [], 0
    for j, column in enumerate(columns):
        distinct, code = np.unique(column, return_inverse=True)
        coded[:, j] = code + width
        values.append(distinct.astype(np.float64))
        width += len(distinct)
    return coded, values


def _merged(coded: np.ndarray, sizes: Sequence[int], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one, with their weights added up."""
    key, size = y.astype(np.int64), 2
    for j, n in enumerate(sizes):
        if size * n >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * n + (coded[:, j] - coded[:, j].min()), size * n
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    return coded[first], y[first], np.bincount(same, weight, len(first))


def _counted(key: np.ndarray, cells: int, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys that occur, in order, and the sum of each of the weights by key; the first of them is positive."""
    if cells <= min(DENSE_CELLS, 32 * len(key)):
        sums = [np.bincount(key, x, cells) for x in weights]
        cell = np.flatnonzero(sums[0])
        return cell, [x[cell] for x in sums]
    cell, number = np.unique(key, return_inverse=True)
    return cell, [np.bincount(number, x, len(cell)) for x in weights]


def grow_out(values: np.ndarray | Sequence[np.ndarray], y: np.ndarray, weight: np.ndarray, factors: Sequence[bool], limits: Limits,
             tree: int, path: int) -> Nodes:
    """A node and all below it, from a matrix or the columns of a matrix.  All nodes of a depth are split at a time.

    Weights are numbers of rows, so their sums are exact and the order of the rows shows in nothing.
    """
    columns = list(values.T) if isinstance(values, np.ndarray) else values
    terms, is_factor = len(columns), np.asarray(factors)
    coded, cell_values = _distinct(columns)
    sizes = [len(each) for each in cell_values]
    coded, y, weight = _merged(coded, sizes, np.asarray(y, np.float64), weight)
    cell_term, cell_value = np.repeat(np.arange(terms), sizes), np.concatenate(cell_values)
    width, positive, found = len(cell_term), weight * y, []
    levels = max([int(each[-1]) + 1 for each, factor in zip(cell_values, factors) if factor] + [1])
    rows, at, paths = np.arange(len(y)), np.zeros(len(y), np.int64), np.array([path])
    while len(paths):
        total = np.bincount(at, weight[rows], len(paths))
        yes = np.bincount(at, positive[rows], len(paths))
        split, threshold, goes_left = np.full(len(paths), -1), np.full(len(paths), np.nan), np.zeros((len(paths), levels), bool)
        found.append(Nodes(paths, split, threshold, goes_left, np.stack([total - yes, yes], axis=1)))
        open_ = (total >= limits.min_split) & (yes > 0) & (yes < total) & (_depth(int(paths[0])) < limits.max_depth)
        if not open_.any():
            break
        live, slot = open_[at], np.cumsum(open_) - 1
        rows, at, opened = rows[live], slot[at[live]], np.flatnonzero(open_)
        tried = _tried(terms, limits, tree, paths[opened])
        key = (at[:, None] * width + coded[rows[:, None], tried[at]]).ravel()
        cell, (n, hits) = _counted(key, len(opened) * width, *[np.repeat(x[rows], tried.shape[1]) for x in (weight, positive)])
        best = best_splits(cell // width, cell_term[cell % width], n, hits, is_factor[cell_term[cell % width]], limits.min_bucket)
        ordered = cell[best.cells] % width
        # The cells from the first to the last of every split node.
        inside = np.zeros(len(cell) + 1, np.int64)
        inside[best.first] += 1
        inside[best.last + 1] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        goes = np.zeros(len(cell), bool)
        goes[best.cells] = inside
        node, term = opened[best.node], cell_term[ordered[best.last]]
        split[node] = term
        number = ~is_factor[term]
        threshold[node[number]] = (cell_value[ordered[best.last[number]]] + cell_value[ordered[best.last[number] + 1]]) / 2
        by_level = np.flatnonzero(inside & is_factor[cell_term[ordered]])
        goes_left[opened[cell[best.cells[by_level]] // width], cell_value[ordered[by_level]].astype(np.int64)] = True
        split_at = split[opened]
        moving = split_at[at] >= 0
        rows, at = rows[moving], at[moving]
        left = goes[np.searchsorted(cell, at * width + coded[rows, split_at[at]])]
        slot = np.full(len(opened), -1)
        slot[best.node] = np.arange(len(best.node))
        at, paths = 2 * slot[at] + ~left, np.stack([2 * paths[node], 2 * paths[node] + 1], axis=1).ravel()
    return Nodes.of(found, levels)


# ---- many trees

def placed(terms: Sequence[Term], prefix: str = "p") -> list[Column]:
    """Level positions and numbers of the terms, by place."""
    return [t.position().alias(f"{prefix}{i}") for i, t in enumerate(terms)]


@dataclass(frozen=True)
class Crown:
    """The upper nodes of a tree: its leaves are open, are to be grown out in a task, or are leaves of the tree."""

    splits: Splits
    path: np.ndarray
    open: np.ndarray
    local: np.ndarray

    @classmethod
    def of(cls, rows: Mapping[int, tuple], open_: set[int], levels: int) -> Crown:
        below = [child for row in rows.values() if row[1] >= 0 for child in (2 * row[0], 2 * row[0] + 1) if child not in rows]
        nodes = Nodes.listed([*rows.values(), *[(path, -1, np.nan, [], 0.0, 0.0) for path in below or ([] if rows else [1])]], levels)
        path = nodes.path[_preorder(nodes.path)]
        is_open = np.array([p in open_ for p in path.tolist()])
        return cls(assembled(nodes, levels), path, is_open, ~is_open & np.array([p not in rows for p in path.tolist()]))


def _compact(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold all of them."""
    with np.errstate(invalid="ignore", over="ignore"):
        for kind in (np.int8, np.int16, np.int32, np.float32):
            small = numbers.astype(kind)
            if np.array_equal(small, numbers):
                return small
    return numbers


def _batched(batches: Iterator[pa.RecordBatch], places: Sequence[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """The columns, the classes and, by tree, the weights of some ``BATCH_ROWS`` rows at a time."""
    held: list[tuple] = []

    def together() -> tuple:
        columns = [np.concatenate([h[0][j] for h in held]) for j in range(len(places))]
        weights = np.ascontiguousarray(np.concatenate([h[2] for h in held]).T)
        return columns, np.concatenate([h[1] for h in held]), weights

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_compact(batch.column(p).to_numpy(zero_copy_only=False)) for p in places]
        weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        held.append((columns, batch.column("y").to_numpy(zero_copy_only=False).astype(np.int8), _compact(weights)))
        if sum(len(h[1]) for h in held) >= BATCH_ROWS:
            yield together()
            held = []
    if held:
        yield together()


CELLS = "tree int, node long, term int, value double, n double, y double, rows double"


def _split_level(rows: DataFrame, crowns: Sequence[Crown], factors: Sequence[bool], limits: Limits) -> DataFrame:
    """``tree, node, term, threshold, levels, no, yes, left, right``: the best splits of the open nodes, and patterns on both sides.

    They come from counts per tree, node, term that is tried, value and class.
    """
    terms, places = len(factors), [f"p{i}" for i in range(len(factors))]
    tried = [_tried(terms, limits, tree, crown.path[crown.open]) for tree, crown in enumerate(crowns)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, y, weights in _batched(batches, places):
            coded, cell_values = _distinct(columns)
            values = np.stack(columns, axis=1).astype(np.float64)
            cell_term, cell_value = np.repeat(np.arange(terms), [len(v) for v in cell_values]), np.concatenate(cell_values)
            width = len(cell_term)
            for tree, crown in enumerate(crowns):
                if not crown.open.any():
                    continue
                slot = np.where(crown.open, np.cumsum(crown.open) - 1, -1)[crown.splits.leaves(values)]
                mine = np.flatnonzero((weights[tree] > 0) & (slot >= 0))
                if not len(mine):
                    continue
                asked = tried[tree][slot[mine]]
                key = (slot[mine][:, None] * width + coded[mine[:, None], asked]).ravel()
                weight = weights[tree][mine].astype(np.float64)
                cell, sums = _counted(key, int(crown.open.sum()) * width, *[
                    np.repeat(x, asked.shape[1]) for x in (weight, weight * y[mine], np.ones(len(mine)))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cell), tree, np.int32)), pa.array(crown.path[crown.open][cell // width]),
                    pa.array(cell_term[cell % width].astype(np.int32)), pa.array(cell_value[cell % width]), *map(pa.array, sums)],
                    names=["tree", "node", "term", "value", "n", "y", "rows"])

    counted = rows.mapInArrow(count, CELLS).groupBy("tree", "node", "term", "value").agg(
        *[F.sum(name).alias(name) for name in ("n", "y", "rows")])

    def one_node(mine: pd.DataFrame) -> pd.DataFrame:
        path, found = int(mine["node"].iloc[0]), (-1, np.nan, [], 0.0, 0.0)
        mine = mine.sort_values(["term", "value"])
        term, n, y = mine["term"].to_numpy(), mine["n"].to_numpy(), mine["y"].to_numpy()
        total, yes = n[term == term[0]].sum(), y[term == term[0]].sum()
        if _depth(path) < limits.max_depth and total >= limits.min_split and 0 < yes < total:
            best = best_splits(np.zeros(len(term), np.int64), term, n, y, np.asarray(factors)[term], limits.min_bucket)
            if len(best.node):
                value, first, last = mine["value"].to_numpy()[best.cells], best.first[0], best.last[0]
                split = int(term[best.cells[last]])
                size = mine["rows"].to_numpy()[best.cells]
                left, whole = size[first:last + 1].sum(), size[term[best.cells] == split].sum()
                found = ((split, np.nan, value[first:last + 1].astype(int).tolist(), left, whole - left) if factors[split] else
                         (split, (value[last] + value[last + 1]) / 2, [], left, whole - left))
        names = ("term", "threshold", "levels", "left", "right")
        return pd.DataFrame({"tree": [mine["tree"].iloc[0]], "node": [path], **{k: [v] for k, v in zip(names, found)},
                             "no": [total - yes], "yes": [yes]})

    return counted.groupBy("tree", "node").applyInPandas(
        one_node, "tree int, node long, term int, threshold double, levels array<int>, left double, right double, no double, yes double")


def _upper(rows: DataFrame, trees: int, factors: Sequence[bool], limits: Limits, levels: int) -> tuple[list[dict[int, tuple]], list[Crown]]:
    """By tree, the nodes of more than ``LOCAL_ROWS`` patterns: a few for each ``LOCAL_ROWS`` of its patterns."""
    upper: list[dict[int, tuple]] = [{} for _ in range(trees)]
    many = rows.count() > LOCAL_ROWS
    open_ = [{1} if many else set() for _ in range(trees)]
    while True:
        crowns = [Crown.of(*both, levels) for both in zip(upper, open_)]
        if not any(open_):
            return upper, crowns
        open_ = [set() for _ in range(trees)]
        for r in _split_level(rows, crowns, factors, limits).collect():
            threshold = np.nan if r.threshold is None else r.threshold  # pandas writes NaN as missing
            upper[r.tree][r.node] = (r.node, r.term, threshold, r.levels, r.no, r.yes)
            sides = [(2 * r.node, r.left), (2 * r.node + 1, r.right)]
            open_[r.tree] |= {path for path, size in sides if size > LOCAL_ROWS}


def dealt_out(rows: DataFrame, count: int) -> DataFrame:
    """Over all tasks.  Hashes of every row and tree take long, also of the rows of a few files; a number that is given is not lowered."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // BATCH_ROWS)))


NODES = "path binary, term binary, threshold binary, goes_left binary, counts binary"


def _grown_out(rows: DataFrame, crowns: Sequence[Crown], factors: Sequence[bool], limits: Limits, levels: int) -> DataFrame:
    """``tree`` and ``NODES``: each node that fits a task with everything below it."""
    places = [f"p{i}" for i in range(len(factors))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, y, weights in _batched(batches, places):
            values = np.stack(columns, axis=1).astype(np.float64)
            for tree, crown in enumerate(crowns):
                at = crown.splits.leaves(values)
                mine = np.flatnonzero((weights[tree] > 0) & crown.local[at])
                mine = mine[np.argsort(at[mine], kind="stable")]
                node, size = np.unique(at[mine], return_counts=True)
                sent = [x[mine] for x in (*columns, weights[tree], y)]
                ends = np.cumsum(size).tolist()
                data = [b"".join(x[a:b].tobytes() for x in sent) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(node), tree, np.int32)), pa.array(crown.path[node]), pa.array(size.astype(np.int32)),
                    pa.array(["".join(x.dtype.char for x in sent)] * len(node), pa.string()), pa.array(data, pa.binary())],
                    names=["tree", "node", "size", "kinds", "data"])

    def rest(mine: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for size, kinds, data in zip(mine["size"], mine["kinds"], mine["data"]):
            starts = np.cumsum([0, *[size * np.dtype(kind).itemsize for kind in kinds]]).tolist()
            parts.append([np.frombuffer(data, kind, size, start) for kind, start in zip(kinds, starts)])
        *columns, weight, y = [np.concatenate(each) for each in zip(*parts)]
        tree, path = int(mine["tree"].iloc[0]), int(mine["node"].iloc[0])
        grown = grow_out(columns, y, weight.astype(np.float64), factors, limits, tree, path)
        return pd.DataFrame({"tree": [tree], **{k: [v] for k, v in grown.packed(levels).items()}})

    nodes = sum(int(crown.local.sum()) for crown in crowns)
    dealt = rows.mapInArrow(deal, "tree int, node long, size int, kinds string, data binary")
    # Much work for few bytes: a number of tasks that is given is not lowered.
    return dealt.repartition(max(1, min(nodes, MOST_TASKS)), "tree", "node").groupBy("tree", "node").applyInPandas(rest, f"tree int, {NODES}")


PACKED = ("tree int, nodes long, levels int, term binary, threshold binary, goes_left binary, right binary, counts binary, labels binary, "
          "saved array<double>")


def packed_trees(patterns: DataFrame, terms: Sequence[Term], weights: Column, trees: int, limits: Limits) -> DataFrame:
    """One row per tree, written: its arrays as bytes, and the impurity that its splits save by term.

    Arguments are those of ``grow_trees``.  Trees are put together in tasks, so the driver sees none of their nodes
    but the upper ones of many patterns.
    """
    count, levels, factors = len(terms), max([len(t.levels) for t in terms] + [1]), [t.is_factor for t in terms]
    names = [field.split()[0] for field in NODES.split(", ")]
    rows = settle(dealt_out(patterns, patterns.count()).select("y", *placed(terms), weights.alias("weights")))
    upper, crowns = _upper(rows, trees, factors, limits, levels)

    def whole(mine: pd.DataFrame) -> pd.DataFrame:
        number = int(mine["tree"].iloc[0])
        parts = [Nodes.unpacked(piece, levels) for piece in mine[names].to_dict("records") if piece["path"] is not None]
        parts.append(Nodes.listed([*upper[number].values()] if parts or upper[number] else [(1, -1, np.nan, [], 0.0, 0.0)], levels))
        tree = assembled(Nodes.of(parts, levels), levels)
        return pd.DataFrame({"tree": [number], **{k: [v] for k, v in tree.packed().items()}, "saved": [tree.gini_saved(count).tolist()]})

    pieces = _grown_out(rows, crowns, factors, limits, levels)
    empty = patterns.sparkSession.range(trees).select(
        F.col("id").cast("int").alias("tree"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema.fields[1:]])
    return settle(pieces.unionByName(empty).groupBy("tree").applyInPandas(whole, PACKED))


def grow_trees(patterns: DataFrame, terms: Sequence[Term], weights: Column, trees: int, limits: Limits) -> list[Splits]:
    """One tree for each of the ``trees`` weights.

    ``patterns`` has the terms, the class ``y`` (0 or 1) and what ``weights``, an
    array with a number of rows per tree, is made of.  A tree without rows is one
    leaf.  Terms must have answers in every pattern.
    """
    return unpacked_all(packed_trees(patterns, terms, weights, trees, limits))


def unpacked_all(packed: DataFrame) -> list[Splits]:
    """The trees of a written table on the driver, in order."""
    return [Splits.unpacked(r.asDict()) for r in packed.drop("saved").orderBy("tree").toLocalIterator()]


def _preorder(path: np.ndarray) -> np.ndarray:
    """The order in which a node comes before those below it and its left side before its right."""
    high, low = (np.frexp(part.astype(np.float64))[1] for part in (path >> 31, path & (1 << 31) - 1))  # exact up to 53 bits
    depth = np.where(high > 0, high + 30, low - 1)
    return np.lexsort((depth, path << (depth.max() - depth)))


def assembled(nodes: Nodes, levels: int) -> Splits:
    """The nodes of one tree in preorder."""
    order = _preorder(nodes.path)
    path, term = nodes.path[order], nodes.term[order]
    by_path, inner = np.argsort(path), term >= 0
    right = np.full(len(path), -1)
    right[inner] = by_path[np.searchsorted(path, 2 * path[inner] + 1, sorter=by_path)]
    wide = np.pad(nodes.goes_left[order], ((0, 0), (0, levels - nodes.goes_left.shape[1])))
    return Splits(term, nodes.threshold[order], wide, np.where(inner, np.arange(1, len(path) + 1), -1), right, nodes.counts[order])
