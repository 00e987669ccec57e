import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import cleaning, distribution, joins, profiling, shares
from surveyloom.operators.running import running_totals
from surveyloom.functions import Levels
from surveyloom.sources import ingest_delimited, read_delimited, scratch_folder, settle, write_delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- joins

def test_missing_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, y int")
    expected = sorted([(None, 1, 10), ("a", 2, 20), ("b", 3, None)], key=repr)
    assert rows(joins.left_merge(left, right, ["k"])) == expected
    assert rows(joins.attach(left, right, ["k"])) == expected


def test_attach_broadcasts_by_bytes(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans, results = [], []
    try:
        for threshold in ("1m", "10b"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            joined = joins.attach(big, small, ["k"])
            plans.append(joined._jdf.queryExecution().sparkPlan().toString())
            results.append(rows(joined))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]
    assert results[0] == results[1]


# ---- running totals

@pytest.mark.parametrize("descending", [False, True])
def test_blocks_give_the_same_totals_as_one_window(spark, descending):
    rng = random.Random(3)
    # One group holds most rows; one group is missing; some hold a single row.
    data = [("hot", float(v), rng.randint(1, 5)) for v in range(400)]
    data += [(None, float(v), 2) for v in range(30)] + [(f"g{i}", 1.0, i) for i in range(5)]
    rng.shuffle(data)
    table = spark.createDataFrame(data, "g string, v double, n bigint")
    plain = running_totals(table, ["g"], "v", ["n"], descending)
    blocks = running_totals(table, ["g"], "v", ["n"], descending, block_rows=20)
    assert rows(blocks.select(*plain.columns)) == rows(plain)
    expected = []
    for g in {d[0] for d in data}:
        mine = sorted(((v, n) for h, v, n in data if h == g), reverse=descending)
        run = np.cumsum([n for _, n in mine])
        for i, (v, n) in enumerate(mine):
            expected.append((g, v, n, int(run[i]), int(run[-1]), mine[i + 1][0] if i + 1 < len(mine) else None))
    assert rows(plain) == sorted(expected, key=repr)


def test_blocks_without_groups(spark):
    table = spark.range(500).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("one"))
    ranked = running_totals(table, [], "v", ["one"], block_rows=50)
    assert ranked.where("one_run <> v + 1 or one_all <> 500").count() == 0
    assert ranked.where("next_value is null").count() == 1


# ---- quantiles and box statistics

@pytest.mark.parametrize("block_rows", [None, 40])
def test_quantiles_interpolate_like_numpy(spark, block_rows):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=301).round(3), "b": rng.integers(0, 9, size=200).astype(float)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)],
                               "g string, x double")
    ranked = distribution.ranked_counts(df, ["x"], ["g"], block_rows)
    got = ranked.groupBy("g").agg(*[distribution.quantile(p).alias(f"q{i}")
                                    for i, p in enumerate((0.0, 0.1, 0.25, 0.5, 0.9, 1.0))])
    for row in got.collect():
        assert np.allclose(row[1:], np.quantile(data[row.g], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)))


@pytest.mark.parametrize("block_rows", [None, 10])
def test_box_statistics(spark, block_rows):
    values = [float(v) for v in [1, 2, 2, 3, 3, 3, 4, 4, 5, 30, -20, 3, 3, 2]]
    df = spark.createDataFrame([(v,) for v in values] * 3, "x double")
    box = distribution.box_stats(df, ["x"], block_rows=block_rows).first()
    q1, median, q3 = np.quantile(values * 3, (0.25, 0.5, 0.75))
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    assert (box.q1, box.median, box.q3) == (q1, median, q3)
    assert (box.whisker_low, box.whisker_high) == (min(inside), max(inside))
    assert box.outliers == 3 * (len(values) - len(inside))
    assert distribution.count_outliers(df, ["x"]).first().outliers == box.outliers


def test_approximate_quantiles_are_actual_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    got = distribution.quantiles(df, ["x"], (0.5,), exact=False).first()
    assert abs(got.value - 499.5) <= 1


def test_outlier_split_is_complete_but_for_missing_values(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(500.0,), (None,)], "x double")
    assert [r.x for r in distribution.outlier_rows(df, "x").collect()] == [500.0]
    assert distribution.without_outliers(df, "x").count() == 100


def test_zscore_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(distribution.zscore(df, "x")).collect()] == [None, None]


# ---- cleaning

def test_second_copies_of_full_rows(spark):
    data = [("a", 1)] * 7 + [("a", None)] * 2 + [(None, None)] * 3 + [("b", 1)]
    df = spark.createDataFrame(data, "x string, y int")
    expected = sorted([("a", 1)] * 6 + [("a", None)] + [(None, None)] * 2, key=repr)
    for portion in (1, 2, 4, 1000):
        assert rows(cleaning.duplicate_rows(df, copies_per_row=portion)) == expected
    assert rows(cleaning.dedupe(df)) == sorted(set(data), key=repr)
    assert profiling.duplicate_count(df).first()[0] == len(expected)


def test_mean_is_taken_at_its_stage(spark):
    df = spark.createDataFrame([("Yes", 2.0, 1), ("Yes", None, 1), ("Yes", 10.0, None), ("No", None, 1)],
                               "smoking string, packs double, other int")
    smoker = F.col("smoking") == "Yes"
    impute = cleaning.impute_mean("packs", among=smoker, where=smoker & F.col("packs").isNull())
    before = cleaning.run_stages(df, [impute, cleaning.drop_missing("other")])
    after = cleaning.run_stages(df, [cleaning.drop_missing("other"), impute])
    assert rows(before.select("packs")) == sorted([(2.0,), (6.0,), (None,)], key=repr)
    assert rows(after.select("packs")) == sorted([(2.0,), (2.0,), (None,)], key=repr)


def test_attrition_counts_each_filter_on_the_rows_left(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 2)], "a int, b int")
    report = cleaning.attrition(df, {"a known": F.col("a").isNotNull(), "b known": F.col("b").isNotNull(),
                                     "a above 1": F.col("a") > 1})
    assert rows(report) == [(1, "a known", 3), (2, "b known", 2), (3, "a above 1", 1)]


def test_range_audit_ignores_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (25.0,), (-1.0,), (None,)], "x double")
    assert rows(cleaning.range_audit(df, {"x": (0, 24)})) == [("x", 2)]


# ---- profiles and shares

def test_declared_levels_without_rows_are_shown(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "x string")
    assert rows(profiling.level_counts(df, {"x": Levels.of(("b", "a"))})) == [("x", "a", 2, 2), ("x", "b", 1, 0)]


def test_profile_spread_is_the_sample_deviation(spark):
    values = [1e9 + v for v in (1.0, 2.0, 4.0, 4.0)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    row = profiling.profile_numeric(df, ["x"]).first()
    assert math.isclose(row.sd, np.std(values, ddof=1), rel_tol=1e-9)
    assert (row.n_valid, row.n_missing, row.n_distinct) == (4, 1, 3)


def test_balanced_share_differs_from_row_share(spark):
    data = [("x", "Yes")] * 1 + [("x", "No")] * 9 + [("y", "Yes")] * 3 + [("y", "No")] * 7
    df = spark.createDataFrame(data, "x string, g string")
    plain = {(r.x, r.g): r.share for r in shares.row_share(df, "x", "g").collect()}
    even = {(r.x, r.g): r.share for r in shares.balanced_share(df, "x", "g").collect()}
    assert math.isclose(plain["x", "Yes"], 0.1)
    assert math.isclose(even["x", "Yes"], (1 / 4) / (1 / 4 + 9 / 16))


def test_a_bin_without_cases_keeps_its_total(spark):
    df = spark.createDataFrame([("a", 1, "Yes"), ("a", 2, "No"), ("b", 1, "No"), (None, 1, "Yes")],
                               "b string, age int, hd string")
    assert rows(shares.rate_by(df, "b", "age", F.col("hd") == "Yes")) == sorted(
        [("a", 2, 1, 1, 50.0), ("b", 1, None, None, None), (None, 1, 1, 1, 100.0)], key=repr)


def test_formula_mean_takes_any_aggregate_and_drops_missing_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0), ("b", None)], "g string, y double")
    assert rows(shares.aggregate_formula(df, "y", ["g"])) == [("a", 2.0)]
    assert rows(shares.aggregate_formula(df, "y", ["g"], fn=lambda c: F.max(c))) == [("a", 3.0)]
    assert rows(shares.group_mean(df, "y", ["g"])) == sorted([("a", 2.0), ("b", None), (None, 9.0)], key=repr)


# ---- files

def test_delimited_files_keep_commas_quotes_and_missing_cells(spark):
    df = spark.createDataFrame([("[10,000, 15,000)", 1.5), ('say "hi"', None), (None, 0.1), ("", 2.0)], "label string, x double")
    path = scratch_folder(spark)
    write_delimited(df, path)
    assert rows(read_delimited(spark, path, df.schema)) == rows(df)
    assert dict(read_delimited(spark, path).dtypes)["x"] == "double"


def test_settled_table_has_no_lineage(spark):
    df = spark.range(10).select((F.col("id") * 2).alias("x"))
    settled = settle(df)
    assert "Range" not in settled._jdf.queryExecution().optimizedPlan().toString()
    assert rows(settled) == rows(df)


# ---- columns without values, whole numbers beyond doubles, whole profiles

def test_columns_without_values_keep_their_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, None), (2, None, 3.0)], "g int, none double, x double")
    found = {r["column"]: r for r in profiling.profile_numeric(df, ["none", "x"]).collect()}
    assert (found["none"].n_valid, found["none"].n_missing, found["none"].n_distinct, found["none"]["mean"]) == (0, 3, 0, None)
    assert (found["x"].n_valid, found["x"].n_missing, found["x"]["median"]) == (2, 1, 2.0)
    assert {r["column"]: r.outliers for r in distribution.count_outliers(df, ["none", "x"]).collect()} == {"none": 0, "x": 0}
    grouped = {(r.g, r["column"]): (r.median, r.outliers) for r in distribution.box_stats(df, ["none", "x"], ["g"]).collect()}
    assert grouped == {(1, "none"): (None, 0), (2, "none"): (None, 0), (1, "x"): (1.0, 0), (2, "x"): (3.0, 0)}


def test_distinct_values_beyond_doubles(spark):
    df = spark.createDataFrame([(2 ** 53 + i,) for i in range(1, 5)], "id bigint")
    assert profiling.profile_numeric(df, ["id"]).first().n_distinct == 4


def test_profile_of_any_table(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, None, None)], "i int, t string, x double")
    numeric, top, repeated = profiling.profile(df)
    assert {r["column"]: r.n_distinct for r in numeric.collect()} == {"i": 2, "x": 1}
    assert [(r["column"], r["value"], r.n, r.type, r.share) for r in top.collect()] == [("t", "a", 2, "string", 1.0)]
    assert repeated.first()[0] == 1
    assert profiling.profile(df.select("t"))[0].count() == 0 and profiling.profile(df.select("i"))[1].count() == 0


def test_merged_sketches_keep_their_rank_error(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).cast("double").alias("x"), (F.col("id") % 3).alias("part"),
                                    F.when(F.col("id") < 0, 1.0).alias("nothing"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(2.0).alias("y"))
    columns, probs = ["x", "nothing", "y"], (0.0, 0.1, 0.5, 0.9, 1.0)
    parts = distribution.quantile_sketches(df, columns, ["part"])
    assert parts.count() == 9
    merged = distribution.merged_sketches(parts.unionByName(parts))  # of tables kept apart
    errors = {(r.column, r.prob): r for r in distribution.rank_errors(df, distribution.sketched_quantiles(merged, probs), columns).collect()}
    assert len(errors) == 10 and all(r.rank_error <= distribution.SKETCH_ERROR for r in errors.values())
    assert all(errors["y", p].value == 2.0 for p in probs)
    one = distribution.merged_sketches(parts, ["part"])
    assert distribution.sketched_quantiles(one, [0.5], ["part"]).count() == 6


def test_rows_that_do_not_parse_go_aside(spark, tmp_path):
    lines = ["id,name,x", "1,a,1.5", '2,"b, c",NA', "three,d,2", "4,e", "5,f,6,7", "6,NA,abc", '7,"x",""', "", "8,g,1e3"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    schema = spark.createDataFrame([], "id int, name string, x double").schema
    good, bad = ingest_delimited(spark, str(tmp_path / "in.csv"), schema, scratch_folder(spark))
    assert sorted((r.id, r.name, r.x) for r in good.where("id <> 7").collect()) == [(1, "a", 1.5), (2, "b, c", None), (8, "g", 1000.0)]
    found = {r.line: r.reason for r in bad.collect()}
    assert found["three,d,2"] == "id: not of type int" and found["6,NA,abc"] == "x: not of type double"
    assert found["4,e"] == "2 cells for 3 columns" and found["5,f,6,7"] == "4 cells for 3 columns"
    assert all(r.file.endswith("in.csv") for r in bad.collect()) and good.columns == ["id", "name", "x"]
