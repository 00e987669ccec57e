import random
from collections import defaultdict

import pytest

from surveyloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=150, most=2):
    """Share by weight, cut what is above the bound, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(ch) for ch in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()) * share / 100, set(order), {}
    while open_:
        part = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if part[s] > most * sizes[s]}
        if not above:
            return target | part
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def documents(seed, n=400):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "\U0001F600", "z", None, ""]
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 5, 30, 200]))),
             rng.choice(sources[: rng.randint(1, len(sources))])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sources_come_near_their_targets(spark, seed):
    docs = documents(seed)
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(found) == len(docs)
    source, size, taken, most = {d[0]: d[2] for d in docs}, defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        size[d[2]] += len(d[1].split())
        most[d[2]] = max(most[d[2]], len(d[1].split()))
    wanted = plain_targets(dict(size))
    for r in found:
        assert r.size == len(docs[r.id][1].split()) and r.taken in (0, r.size, 2 * r.size)
        assert r.source_size == size[source[r.id]] and r.target == pytest.approx(wanted[source[r.id]])
        taken[source[r.id]] += r.taken
    for s in size:
        assert abs(taken[s] - wanted[s]) <= most[s] / 2


def test_a_smaller_mix_is_part_of_a_larger_one(spark):
    docs = spark.createDataFrame(documents(4), "doc_id long, text string, source string")
    mixes = [{r.id: r.taken for r in mixing.mix(docs, share=share).collect()} for share in (20, 90, 150, 200)]
    for less, more in zip(mixes, mixes[1:]):
        assert all(less[i] <= more[i] for i in less)
    assert mixes[0] == {r.id: r.taken for r in mixing.mix(docs.repartition(5), share=20).collect()}


def test_repeated_rows_are_told_apart(spark):
    rows = [(1, "a b c", "x")] * 500 + [(2, "d e", "y")] * 100 + [(3, None, "x"), (None, "", None), (4, "  q", None)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")
                       .selectExpr("*", "1 as size", "2 as first", "3 as open")).collect()
    assert len(found) == len(rows)
    targets = plain_targets({"x": 1500, "y": 200, None: 2})
    for i, source in ((1, "x"), (2, "y")):
        mine = [r for r in found if r.id == i]
        assert abs(sum(r.taken for r in mine) - targets[source]) <= 1.5
    assert [(r.size, r.taken) for r in found if r.id == 3] == [(0, 0)]
    assert [r.size for r in found if r.id == 4] == [2]


def test_tables_without_words(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert sorted((r.id, r.size, r.source_size, r.target, r.taken) for r in blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], schema), share=201)
