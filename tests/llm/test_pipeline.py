"""Every stage against a plain version on what the stage before it kept."""

import corpus_pipeline
import pyarrow as pa
import pytest
from plain import DOCS, contamination, near_components, odd_rows, remainder
from test_packing import check

from surveyloom.llm import quality
from surveyloom.llm.queries import quality_model

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER))
    return [*out, docs]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_quality(spark, kept):
    model = quality_model(spark, kept[0], FOLDER)
    given = pairs(kept[0])
    scores = model.score(quality.features_of(pa.array([t for _, t in given])))
    assert sorted(pairs(kept[1])) == sorted(g for g, s in zip(given, scores, strict=True) if s >= 0.7)
    assert any(remainder(i, 4) == 2 for i, _ in given)


def test_exact_copies(kept):
    largest = {}
    for i, t in pairs(kept[1]):
        largest[t] = max(i, largest.get(t, i))
    assert sorted(pairs(kept[2])) == sorted((i, t) for t, i in largest.items())


def test_near_copies(kept):
    given = pairs(kept[2])
    found = near_components(given)
    assert sorted(pairs(kept[3])) == sorted((i, t) for i, t in given if found[i][1] == i)


def test_contaminated(spark, kept):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = []
    for i, t in pairs(kept[3]):
        words, hit, _ = contamination(t, items)
        if not (hit > 0 and 20 * hit >= words):
            clean.append((i, t))
    assert sorted(pairs(kept[4])) == sorted(clean)


def test_packing(kept):
    check(kept[5].collect(), [t for _, t in pairs(kept[4])], 4096)
    assert {r.doc_id for r in kept[5].collect()} == {i for i, _ in pairs(kept[4])}


def test_run_gives_what_the_stages_give(spark, kept):
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == kept[5].columns and whole.count() == kept[5].count()


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_odd_rows_pass_every_stage(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, FOLDER))
    assert (docs.count() > 0) == bool(rows)
