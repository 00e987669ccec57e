import random

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCS, near_components, odd_rows, shingles

from surveyloom.llm import near_dedup
from surveyloom.llm.superminhash import shingle_sets, signatures


def test_shingle_sets_have_the_size_of_the_real_ones():
    texts = ["a b c d e f", "A  b\tc d e f", "a b", "", " \n", "x " * 40, "é É a A b c d e"]
    sets = shingle_sets(pa.array(texts), 5)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[0], sets[1])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 1000):
        for share in (0.2, 0.75):
            errors = []
            for _ in range(20):
                both = rng.integers(0, 2 ** 63, max(int(size * share), 1), dtype=np.uint64)
                only = [rng.integers(0, 2 ** 63, size - len(both), dtype=np.uint64) for _ in range(2)]
                a, b = signatures([np.unique(np.concatenate([both, o])) for o in only], 128)
                errors.append((a == b).mean() - len(both) / (2 * size - len(both)))
            assert abs(np.mean(errors)) < 0.03


def test_signature_of_a_set_does_not_depend_on_its_batch():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (1, 2, 50, 700, 0)]
    together = signatures(sets, 128)
    for i, s in enumerate(sets[:-1]):
        assert np.array_equal(together[i], signatures([s], 128)[0])
        assert (together[i] < np.iinfo(np.int64).max).all()


def families(seed):
    """Groups of near copies, chains of small changes, unrelated texts with a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
    chain = [rng.choice(vocabulary) for _ in range(80)]
    for k in range(10):
        chain = list(chain)
        chain[(8 * k) % 80] = f"new{k}"
        texts.append(chain)
    for _ in range(12):
        texts.append(passage + [rng.choice(vocabulary) for _ in range(rng.randint(3, 15))])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "pivots", "crowd"), [(1, 3, 2), (2, 1024, 4), (3, 1024, 32)])
def test_components_equal_brute_force(spark, seed, pivots, crowd, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    docs = families(seed)
    found = near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == near_components(docs)
    assert all(r.kept == (r.id == r.component_id) for r in found)


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "1 as row", "2 as cls", "3 as bucket", "4 as mark")
    found = near_dedup.near_groups(docs).collect()
    assert len(found) == len(odd_rows())
    same = [r for r in found if r.n_shingles == 2]
    assert {r.component_id for r in same} == {3} and sum(r.kept for r in same) == 1
    assert {r.component_id for r in found if r.n_shingles > 100} == {7}
    assert all(r.kept for r in found if r.n_shingles == 0)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, None, 7, 9, 10], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.drop_near_copies(empty).count() == 0


def test_a_large_group_around_the_limit_forms_few_pairs(spark, monkeypatch):
    """Families of near copies whose members lie just under the limit to each other: hardly any pair across need be compared."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for family in range(6):
        head = list(base)
        for k in range(5):  # every family has its own changes, some 0.7 from the others'
            head[7 + 20 * k + family] = f"f{family}x{k}"
        for member in range(60):
            words = list(head)
            words[rng.randrange(110, 120)] = f"m{family}x{member}"
            texts.append(words)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    formed, across = [], near_dedup._pairs_across

    def counted(members, similarity):
        pairs, left = across(members, similarity)
        formed.append(pairs.count())
        return pairs, left

    monkeypatch.setattr(near_dedup, "_pairs_across", counted)
    found = near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == near_components(docs)
    assert len({r.component_id for r in found}) == 6
    assert sum(formed) < 2 * len(docs)


def test_parity_maps_never_exceed_the_difference(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(-2 ** 63, 2 ** 63, n)) for n in (0, 1, 50, 3000, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], rng.integers(-2 ** 63, 2 ** 63, len(s) // 3 + 1)])) for s in sets]
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "cls long, shingles array<long>")
    maps = {r.cls: r.parities for r in near_dedup._parity_maps(frame).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = sum(((x ^ y) & (2 ** 64 - 1)).bit_count() for x, y in zip(maps[i], maps[j]))
            assert apart <= len(np.setxor1d(a, b)) and (i == j or apart > 0)
