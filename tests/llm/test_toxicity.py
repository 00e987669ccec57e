import numpy as np
import pyarrow as pa
from plain import DOCS, odd_rows
from pyspark.sql import functions as F

from surveyloom.llm import gru, toxicity
from surveyloom.llm.queries import ENTRIES


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    weights = {k: v.astype(np.float64) for k, v in gru.initial(5, 3, 4, rng).items()}
    inputs, mask = rng.normal(size=(6, 7, 5)), np.ones((6, 7), bool)
    mask[2, 4:] = False
    labels = rng.integers(0, 2, 6)

    def loss(w, x):
        table = np.concatenate([np.zeros((1, 5)), x.reshape(-1, 5)])
        windows = np.where(mask, np.arange(1, 43).reshape(6, 7), 0)
        odds = gru.log_odds(w, gru.gate_inputs(w, table), windows)
        return np.mean(np.log1p(np.exp(odds)) - labels * odds)

    grad, d_inputs = gru.gradients(weights, inputs, mask, labels)
    for name, value in weights.items():
        for at in list(np.ndindex(value.shape))[::7]:
            up, down = {k: v.copy() for k, v in weights.items()}, {k: v.copy() for k, v in weights.items()}
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            assert np.isclose((loss(up, inputs) - loss(down, inputs)) / 2e-3, grad[name][at], atol=2e-4), name
    up, down = inputs.copy(), inputs.copy()
    up[1, 3, 2] += 1e-3
    down[1, 3, 2] -= 1e-3
    assert np.isclose((loss(weights, up) - loss(weights, down)) / 2e-3, d_inputs[1, 3, 2], atol=2e-4)


def test_windows_cover_every_word():
    sizes = [0, 1, 15, 16, 17, 24, 25, 100]
    codes = np.concatenate([np.arange(n) for n in sizes]).astype(np.int64)
    windows, text = toxicity._windows(np.cumsum(sizes), codes)
    for i, n in enumerate(sizes):
        mine = windows[text == i]
        assert set(mine[mine > 0].tolist()) == set(range(1, n + 1))
        assert len(mine) == max(1, 1 + -(-(n - toxicity.WINDOW) // toxicity.STRIDE))


def test_scores_do_not_depend_on_the_batch_and_whole_texts_count():
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(["one", "two", "three", "four"], 30)) for _ in range(150)]
    toxic = [c + " idiotic " + c for c in clean[:50]]
    network = toxicity.train(pa.array(clean + toxic), np.array([0] * 150 + [1] * 50))
    texts = ["", "one two", "one " * 5000 + "IDIOTIC!", "one " * 5000, "idiotical two"]
    scores = toxicity.score_texts(network, pa.array(texts))
    assert scores[2] > 0.5 > scores[3] and scores[4] > 0.5 and scores[1] < 0.5
    for i, t in enumerate(texts):
        assert np.isclose(scores[i], toxicity.score_texts(network, pa.array([t]))[0], atol=1e-5)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = ENTRIES["op2_toxicity"].run(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) > 0.96 * len(rows)
    assert hits > 0.75 * sum(r.toxic for r in rows) and hits > 0.9 * sum(r.predicted for r in rows)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS).selectExpr("*", "1 as id", "2 as score")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (7, 1), (None, 1), (8, None), (4, 1)],
                                   "doc_id long, toxic int")
    network = toxicity.fit(docs, labels, F.lit(True))
    scores = toxicity.toxicity_scores(docs, network).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    none = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert {round(r.score, 6) for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(spark.createDataFrame([], DOCS), network).count() == 0
