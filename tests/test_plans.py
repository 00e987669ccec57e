"""What the plans must look like to hold up on large tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from surveyloom.models import logit
from surveyloom.operators import profiling, sampling
from surveyloom.plans import heart, heart_queries
from surveyloom.sources import read_table, scratch

FOLDER = "/root/testdata/sf0.001"
QUERIES = contract.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def full_plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_scan_reads_only_the_projected_columns(spark):
    text = plan(QUERIES["scan_project"](spark, FOLDER))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_filters_reach_the_scan(spark):
    assert "Or(And(GreaterThan(l_quantity,30.0),LessThan(l_discount,0.05)),EqualTo(l_returnflag,R))" in plan(
        QUERIES["filter_compare"](spark, FOLDER))
    cleaned = full_plan(QUERIES["survey_clean"](spark, FOLDER))
    for column in ("wtkg_x100", "htm_cm"):
        assert f"IsNotNull({column})" in cleaned


@pytest.mark.parametrize("name", ["recode_labels", "decode_units", "conditional_update", "fifelse_category", "bin_cut",
                                  "outlier_removal", "zscore", "impute_group_mean", "score_probability"])
def test_row_wise_work_does_not_shuffle_the_table(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    # A scalar subquery gathers its one row; the table itself stays where it is.
    for kind in ("hashpartitioning", "rangepartitioning", "RoundRobinPartitioning"):
        assert kind not in text


@pytest.mark.parametrize("name", ["null_counts", "attrition_report", "range_audit", "null_cooccurrence"])
def test_audits_scan_the_table_once(spark, name):
    assert plan(QUERIES[name](spark, FOLDER)).count("FileScan") == 1


def test_top_values_are_limited_before_the_shuffle(spark):
    text = plan(profiling.profile_topk(read_table(spark, FOLDER, "part"), ["p_brand", "p_type"], k=3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sampling_does_not_shuffle_the_table(spark):
    rows = spark.range(1000).select(F.col("id").alias("resp_id"), (F.col("id") % 3 == 0).cast("string").alias("hd"))
    text = plan(sampling.split_stratified(rows, "hd", "resp_id"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_no_query_multiplies_two_tables(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "BatchEvalPython" not in text


def test_wide_projections_are_written_in_methods_the_jvm_compiles(spark, monkeypatch):
    before, seen, write = spark.conf.get(scratch.METHOD_LIMIT), [], scratch.settle

    def watched(df):
        seen.append(spark.conf.get(scratch.METHOD_LIMIT))
        return write(df)

    monkeypatch.setattr(scratch, "settle", watched)
    raw = spark.range(3).select(*[F.lit(None).cast("string" if name == "INCOME" else "double").alias(name) for name in heart.COLUMNS])
    assert heart.clean(raw).count() == 0
    assert seen == [str(scratch.COMPILED_BYTES)] and spark.conf.get(scratch.METHOD_LIMIT) == before
    with pytest.raises(Exception):
        scratch.settle_wide(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(scratch.METHOD_LIMIT) == before


@pytest.mark.parametrize("incomplete, counted", [(0, 2), (5, 3)])
def test_models_on_the_same_rows_share_their_patterns(spark, monkeypatch, incomplete, counted):
    rng = random.Random(3)
    rows = [(True, rng.choice(["No", "No", "Yes"]), *[rng.choice(t.levels) if t.is_factor else float(rng.randint(0, 9)) for t in heart.ALL_TERMS])
            for _ in range(600)]
    names = ["train", "HEART_DISEASE", *[t.name for t in heart.ALL_TERMS]]
    kinds = ["boolean", "string", *["string" if t.is_factor else "double" for t in heart.ALL_TERMS]]
    rows = [tuple(None if i < incomplete and n == "EXERCISE" else v for n, v in zip(names, row)) for i, row in enumerate(rows)]
    parts = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).localCheckpoint()
    calls, count = [], heart_queries.answer_patterns
    monkeypatch.setattr(heart_queries, "heart_parts", lambda *_: parts)
    monkeypatch.setattr(heart_queries, "answer_patterns", lambda *a: calls.append(a) or count(*a))
    got = {r["model"]: r for r in heart_queries.heart_glm_statistics(spark, "").collect()}
    assert len(calls) == counted
    for name, terms in (("all", heart.ALL_TERMS), ("reduced", heart.REDUCED_TERMS), ("final", heart.FINAL_TERMS)):
        want = logit.fit_statistics(spark, logit.fit_logit(count(parts, terms, "HEART_DISEASE", "Yes"), terms)).first()
        for column, value in want.asDict().items():
            assert got[name][column] == pytest.approx(value, rel=1e-8)
