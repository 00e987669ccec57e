import random

import pytest
from plain import DOCS, odd_rows, sha

from surveyloom.llm import exact_dedup


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), sha(text)) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1, 3, 4096])
def test_groups_equal_brute_force(spark, block_bytes):
    rng = random.Random(block_bytes)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    rows = [(i, rng.choice([*texts, None])) for i in range(120)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes)
    got = found.collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    assert all(r.kept == (r.id == r.keep_id) for r in got)


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    clash = docs.selectExpr("*", "1 as row", "'x' as digest", "2 as name", "3 as blocks", "4 as id", "5 as `at`")
    got = exact_dedup.exact_groups(clash).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(
        [r[:2] for r in odd_rows()])
    stays = {}
    for r in got:
        stays[r.text_sha256] = stays.get(r.text_sha256, 0) + r.kept
    assert set(stays.values()) == {1}
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(t.text or "" for t in kept.collect()) == sorted({r[1] or "" for r in odd_rows()})


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
