import random
from itertools import product as grid

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import hard_negatives
from surveyloom.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, label int, embedding array<long>"


@pytest.mark.parametrize(("width", "bits"), [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours(width, bits):
    cells = np.array(list(grid(range(1 << bits), repeat=width)))
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_reached():
    rng = np.random.default_rng(1)
    for _ in range(50):
        low = rng.integers(-20, 20, 3)
        high = low + rng.integers(0, 9, 3)
        vectors = rng.integers(-9, 9, (4, 3))
        corners = np.array(list(grid(*zip(low, high))))
        bottom, top = hard_negatives.score_bounds(vectors, low, high)
        assert (bottom == (vectors @ corners.T).min(axis=1)).all() and (top == (vectors @ corners.T).max(axis=1)).all()


def test_products_are_exact_at_every_size():
    for size in (3, 2 ** 28, 2 ** 31, 2 ** 62):
        a = np.array([[size, -size + 1], [1, size]], np.int64)
        assert hard_negatives.products(a, a).tolist() == [[int(x) * int(u) + int(y) * int(v) for u, v in a.tolist()] for x, y in a.tolist()]


def plain_negatives(rows, every):
    found = []
    for anchor, label, vector in rows:
        if anchor is None or anchor % every:
            continue
        def score(other):
            return sum(x * y for x, y in zip(vector, other))
        ranked = sorted(((-score(v), i is None, i or 0, lab, i) for i, lab, v in rows), key=lambda r: r[:3])
        for good in [r for r in ranked if r[3] == label and r[4] != anchor][:5]:
            hard = [r for r in ranked if r[3] != label and 80 * -good[0] <= 100 * -r[0] <= 100 * -good[0]][:5]
            found += [(anchor, good[4], k + 1, r[4], -good[0], -r[0]) for k, r in enumerate(hard)]
    return sorted(found, key=repr)


def clusters(seed, n=600, width=4, spread=6):
    rng = random.Random(seed)
    centres = [[rng.randint(-90, 90) for _ in range(width)] for _ in range(12)]
    return [(i, rng.randrange(3), [c + rng.randint(-spread, spread) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("anchors", [2048, 7])
def test_negatives_equal_brute_force(spark, anchors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "BATCH_ROWS", 16)
    rows = clusters(1)
    read = []
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as place", "3 as id"),
                                F.col("vec_id") % 20 == 0,
                                report=lambda n, total: read.append(n / total))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_negatives(rows, 20)
    # Neighbours are asked for together, so most blocks need not be read.
    assert anchors > 7 or np.mean(read) < 0.7


def test_ties_repeated_rows_and_odd_vectors(spark):
    rows = [(i, i % 2, [7, 1]) for i in range(1, 60)] + [(0, 0, [5, 5]), (None, 1, [7, 0]), (None, 0, [9, 9]),
                                                         (61, 0, [6]), (62, 1, []), (63, 1, [0, 0]), (64, 0, [-3, -3])]
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 32 == 0)
    padded = [(i, lab, (v + [0, 0])[:2]) for i, lab, v in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_negatives(padded, 32)
    twice = hard_negatives.mine(spark.createDataFrame(rows + [(0, 0, [5, 5])], SCHEMA), F.col("vec_id") == 0)
    once = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(1, 1, [0.5, nan]), (2, 1, [inf, 0.0]), (3, None, [0.0, 0.0]), (4, 1, None), (5, 1, [None, 0.5]), (6, 1, [0.5, -0.001]), (7, 0, [])]
    kept = hard_negatives.usable(spark.createDataFrame(raw, "vec_id long, label int, embedding array<float>"), "embedding", "label")
    assert [(r.vec_id, list(r.v)) for r in kept.select("vec_id", hard_negatives.whole_numbers(F.col("embedding")).alias("v")).collect()] == [
        (6, [128, -1]), (7, [])]
    for rows in ([], [(1, 1, [1])], [(100, 1, [])]):
        assert hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
