import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import DOCS, odd_rows, remainder, spaced_words
from suffix_tree import SuffixTree
from pyspark.sql import functions as F

from surveyloom.llm import language_model
from surveyloom.llm.common import remainder as column_remainder


def held_out():
    return column_remainder("doc_id", 7) == 2


def check_base(rows, docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        if remainder(doc_id, 7) != 2:
            counts.update([*spaced_words(text), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in docs:
        words = [*spaced_words(text), "\n"]
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        want.append((doc_id, remainder(doc_id, 7) == 2, len(words), sum(counts[w] > 0 for w in words), total, score))
    got = [(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows]
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-9)


def test_base_score_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["The", "the", "été", "b", f"r{i}"]) for _ in range(rng.randint(0, 30))))
            for i in range(80)]
    rows = language_model.scores(spark.createDataFrame(docs, "doc_id long, text string"), held_out()).collect()
    check_base(rows, docs)


def test_odd_rows_empty_table_and_no_training(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "1 as row", "2 as symbols", "3 as word", "4 as id")
    check_base(language_model.scores(docs, held_out()).collect(), [r[:2] for r in odd_rows()])
    assert language_model.scores(spark.createDataFrame([], DOCS), held_out()).count() == 0
    alone = language_model.scores(docs, F.lit(True)).collect()
    assert {r.score for r in alone} == {0.0} and {r.n_known for r in alone} == {0}


def grown(texts, symbols, depth=3, least=2):
    flat = np.concatenate([[*t, 0] for t in texts]).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.bincount(flat, minlength=symbols)
    tree = SuffixTree((counts + 1) / (counts + 1).sum(), end=0)
    tree.first_contexts(counts, least)
    for level in range(1, depth + 1):
        keys, times = tree.count(flat, ends, level)
        often = times >= 2
        tree.grow(keys[often], times[often], least, len(flat))
    return tree, flat, ends


def test_every_state_is_a_distribution_and_contexts_help():
    rng = random.Random(2)
    texts = []
    for _ in range(200):
        text = [rng.randint(1, 9)]
        for _ in range(20):
            # What follows depends on the last two symbols.
            last = sum(text[-2:])
            text.append(1 + last % 9 if rng.random() < 0.8 else rng.randint(1, 9))
        texts.append(text)
    tree, flat, ends = grown(texts, 10)
    assert len(tree.parent) > 10
    for state in range(len(tree.parent)):
        chances = 10 ** tree.log_chance(np.full(10, state), np.arange(10))
        assert chances.sum() == pytest.approx(1)
    assert tree.score(flat, ends).sum() > 1.2 * tree.root[flat].sum() * 0.9 and tree.score(flat, ends).sum() > tree.root[flat].sum() + 500


def test_independent_symbols_need_no_contexts():
    rng = random.Random(3)
    tree, *_ = grown([[rng.randint(1, 5) for _ in range(20)] for _ in range(200)], 6)
    # The end of a text is the only context that says something.
    assert len(tree.parent) <= 3


def test_query_beats_single_words_on_held_out_texts(spark):
    from surveyloom.llm.queries import ENTRIES

    rows = [r for r in ENTRIES["op4_language_model"].run(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.05 * sum(r.n_tokens for r in rows)


def test_tables_score_as_the_tree_in_memory_and_grow_with_the_corpus(spark):
    rng = random.Random(4)
    names, docs = [f"w{i}" for i in range(400)], []
    for i in range(700):
        text = [rng.randrange(400)]
        for _ in range(rng.randint(0, 60)):
            text.append((7 * text[-1] + sum(text[-3:]) % 5) % 400 if rng.random() < 0.7 else rng.randrange(400))
        docs.append((i, " ".join(names[x] for x in text)))
    seen = sorted({w for i, t in docs if remainder(i, 7) != 2 for w in t.split()})
    number = {"\n": 0, **{w: k for k, w in enumerate(seen, start=1)}}
    coded = {i: [number.get(w, len(number)) for w in t.split()] for i, t in docs}
    train = [t for i, t in coded.items() if remainder(i, 7) != 2]
    flat = np.concatenate([[*t, 0] for t in train])
    counts = np.bincount(flat, minlength=len(number) + 1)
    tree = SuffixTree((counts + 1) / (counts + 1).sum(), end=0)
    tree.first_contexts(counts, language_model.CONTEXT_SEEN)
    for level in (1, 2, 3):
        keys, times = tree.count(flat, np.cumsum([len(t) + 1 for t in train]), level)
        tree.grow(keys[times >= 2], times[times >= 2], language_model.CONTEXT_SEEN, len(flat))
    # Contexts under a ten-thousandth of the tokens, and some of two words, are among the states.
    assert sum(level.kept.sum() for level in tree.levels[:3]) > 100 and tree.levels[1].kept.any()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for r in language_model.scores(frame, held_out()).collect():
        text = np.array([*coded[r.id], 0])
        assert r.score == pytest.approx(tree.score(text, np.array([len(text)])).sum(), abs=1e-8)


def test_strings_that_no_task_looks_up_are_joined(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i + j * j) % 40}" for j in range(30))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {r.id: r.score for r in language_model.scores(frame, held_out()).collect()}
    monkeypatch.setattr(language_model, "HOT_SHARE", 0.02)
    for r in language_model.scores(frame, held_out()).collect():
        assert r.score == pytest.approx(whole[r.id], abs=1e-8)


def test_contexts_under_a_ten_thousandth_of_the_tokens_count(spark):
    # 12,000 words of equal counts; the second and third word of a text follow from the one before.
    docs = spark.range(100_000).selectExpr(
        "id as doc_id", "concat_ws(' ', concat('a', id % 4000), concat('b', id % 4000), concat('c', id % 4000)) as text")
    rows = language_model.scores(docs, held_out()).where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.count("*").alias("n")).first()
    assert rows.score > rows.base + 6 * rows.n


def test_strings_of_the_texts_are_never_written(spark, monkeypatch):
    # Written and shuffled, they took more than four times the texts on disk.
    written = []
    settle = language_model.settle
    monkeypatch.setattr(language_model, "settle", lambda df: written.append(df.dtypes) or settle(df))
    frame = spark.createDataFrame([(i, " ".join(f"w{(i + j * j) % 40}" for j in range(30))) for i in range(50)], "doc_id long, text string")
    assert language_model.scores(frame, held_out()).count() == 50
    assert written and not [column for table in written for column in table if column[1].startswith("array")]


def test_few_strings_share_all_their_marks(spark):
    rng = np.random.default_rng(5)
    inside, outside = (rng.integers(0, 1 << 63, 500_000, dtype=np.uint64) * np.uint64(2) + np.uint64(i) for i in (0, 1))
    found = language_model._bit_map(spark.createDataFrame(pa.table({"key": inside.view(np.int64)})))
    assert language_model._mapped(found, inside).all()
    assert language_model._mapped(found, outside).mean() < 0.001


def test_word_hashes_do_not_depend_on_where_bytes_are_cut(monkeypatch):
    words = pa.array(["a", "b", "ab", "ba", "été", "x" * 3000, "x" * 3001, "aa", "a"])
    whole = language_model._word_hashes(words)
    assert whole[0] == whole[-1] and len(set(whole.tolist())) == len(words) - 1
    monkeypatch.setattr(language_model, "HASHED_BYTES", 7)
    assert (language_model._word_hashes(words) == whole).all() and (language_model._word_hashes(words[3:]) == whole[3:]).all()
    assert len(language_model._word_hashes(words[:0])) == 0
