import numpy as np
import pyarrow as pa
from plain import DOCS, odd_rows
from pyspark.sql import functions as F

from surveyloom.llm import gam, quality
from surveyloom.llm.queries import ENTRIES


def test_tables_learn_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    odds = 6 * (x[:, 0] > 0.6) - 3 + 10 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 5
    y = (rng.random(4000) < 1 / (1 + np.exp(-odds))).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs
    right = ((model.score(x[3000:]) > 0.5) == (odds[3000:] > 0)).mean()
    assert right > 0.95
    by_hand = model.intercept + sum(t[np.searchsorted(e, x[0, j], side="right")] for j, (t, e) in enumerate(
        zip(model.tables, model.edges, strict=True)))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        by_hand += t[tuple(np.searchsorted(model.pair_edges[f], x[0, f], side="right") for f in (i, j))]
    assert np.isclose(model.raw(x[:1])[0], by_hand)


def test_one_label_or_none_gives_a_constant():
    assert np.allclose(gam.fit(np.zeros((0, 2)), np.zeros(0)).score(np.ones((2, 2))), 0.5)
    assert (gam.fit(np.random.default_rng(1).random((50, 2)), np.ones(50)).score(np.zeros((1, 2))) > 0.9).all()


def test_features_do_not_depend_on_the_batch():
    texts = [r[1] or "" for r in odd_rows()] + ["a | b | c", "Aa Aa Aa\nAa\nAa", "x %%% $$$"]
    together = quality.features_of(pa.array(texts))
    assert np.isfinite(together).all()
    for i, text in enumerate(texts):
        assert np.allclose(together[i], quality.features_of(pa.array([text]))[0])
    named = dict(zip(quality.FEATURES, quality.features_of(pa.array(["Aa Aa b!\nb!"]))[0], strict=True))
    assert named["distinct_words"] == 0.5 and named["repeated_words"] == 0.5 and named["distinct_lines"] == 1
    assert np.isclose(named["capitals"], 2 / 8) and np.isclose(named["shouts"], 2 / 8)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = ENTRIES["op1_quality"].run(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "1 as id", "2 as features", "3 as score")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (7, 1), (None, 1), (8, None), (4, 1)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    scores = quality.quality_scores(docs, model).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    none = quality.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(empty, model).count() == 0 and quality.drop_low_quality(empty, model).count() == 0
    assert quality.drop_low_quality(docs, model, threshold=0.0).count() == len(odd_rows())
