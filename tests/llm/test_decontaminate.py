import random

import pytest
from plain import DOCS, contamination, normal_words, odd_rows

from surveyloom.llm import decontaminate


def rows_of(found):
    return sorted(((r.id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()), key=repr)


def expected(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, named = contamination(text, items)
        out.append((doc_id, words, hit, tuple(sorted(named)), hit > 0 and 20 * hit >= words))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_windows", [3, 100_000])
def test_equals_brute_force(spark, block_windows):
    rng = random.Random(1)
    words = ["The", "été", "B2", "of", "x"]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 5, 13, 14, 30, 0])]
    items += [("7", items[5][1]), (None, "alone unnamed"), ("8", None)]
    docs = [(i, " ".join(rng.choice([*words, "zz", "q-q"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, "a b " + items[5][1].replace(" ", ", ") + " c"), (101, "alone  UNNAMED"), (102, None), (103, "")]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id string, text string"), block_windows=block_windows)
    assert rows_of(found) == expected(docs, items)


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "1 as words", "2 as hash", "3 as place", "4 as mark")
    items = [("a", "same words here and there again"), ("b", " ".join(f"w{i % 977}" for i in range(500, 540)))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(decontaminate.contamination(docs, benchmark)) == expected([r[:2] for r in odd_rows()], items)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [i for i, *_, bad in expected([r[:2] for r in odd_rows()], items) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_spans_are_taken_out(spark):
    docs = spark.createDataFrame([(1, "(Keep) one two-three four, end."), (2, "nothing here"), (3, None)],
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "two three FOUR")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert got == {1: "(Keep) one end.", 2: "nothing here", 3: None}
    assert normal_words(got[1]) == ["keep", "one", "end"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(odd_rows(), DOCS)
    assert decontaminate.contamination(docs, items).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(some, items).collect()] == [0] * len(odd_rows())
