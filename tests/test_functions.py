import pytest
from pyspark.sql import functions as F

from surveyloom.functions import (Codebook, Levels, UnitRule, blank_to_null, cut, decode_units, fifelse,
                                  fill_missing, in_set, label_above, round_even, sentinel_to_null,
                                  sentinel_to_value, update)
from surveyloom.plans.survey import ALCOHOL_UNITS


def values(df, *columns):
    return [tuple(row) if len(row) > 1 else row[0] for row in df.select(*columns).collect()]


def codes(spark):
    return spark.createDataFrame([(0, None), (1, 88), (2, 77), (3, 5)], "i int, x int").orderBy("i").coalesce(1)


def test_missing_condition_gives_missing_result(spark):
    x = F.col("x")
    df = codes(spark)
    assert values(df, fifelse(x > 50, "high", "low")) == [None, "high", "high", "low"]
    assert values(df, label_above(x, 77)) == [None, "Yes", "No", "No"]


def test_membership_is_never_missing(spark):
    assert values(codes(spark), in_set(F.col("x"), [77]), ~in_set(F.col("x"), [77])) == [
        (False, True), (False, True), (True, False), (False, True)]


def test_sentinels(spark):
    x = F.col("x")
    df = codes(spark)
    assert values(df, sentinel_to_null(x, [77, 99])) == [None, 88, None, 5]
    assert values(df, sentinel_to_value(x, {88: 0})) == [None, 0, 77, 5]


def test_update_keeps_rows_with_a_missing_condition_and_lets_the_last_rule_win(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (9, "c")], "x int, y string").coalesce(1)
    rules = [(F.col("x") > 0, "some"), (F.col("x") > 5, "many")]
    assert values(df, update(F.col("y"), rules)) == ["a", "some", "many"]
    assert values(df, update(F.col("y"), [])) == ["a", "b", "c"]


def test_codebook_merges_labels_and_nulls_unlisted_codes(spark):
    book = Codebook.of({1: "Yes", 2: "Yes, but during pregnancy", 3: "No", 4: "No"})
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9, None)], "x int").coalesce(1)
    expected = ["Yes", "Yes, but during pregnancy", "No", "No", None, None]
    assert values(df, book.label(F.col("x"))) == expected
    assert book.levels.labels == ("Yes", "Yes, but during pregnancy", "No")


def test_level_order_and_placeholder(spark):
    levels = Levels.of(("low", "mid", "high")).with_label("Missing")
    df = spark.createDataFrame([("high",), ("other",), (None,)], "x string").coalesce(1)
    assert values(df, levels.ordinal(F.col("x"))) == [3, None, None]
    assert values(df, levels.ordinal(fill_missing(F.col("x")))) == [3, None, 4]
    assert [tuple(r) for r in levels.table(spark).orderBy("ord").collect()] == [
        ("low", 1), ("mid", 2), ("high", 3), ("Missing", 4)]


def test_bins_are_closed_on_the_right(spark):
    breaks, labels = (0, 1, 5, 10), ("[0]", "[1 - 5]", "[6 - 10]")
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 0.5, 1.0, 1.5, 5.0, 5.5, 10.0, 10.5, None)],
                               "x double").coalesce(1)
    assert values(df, cut(F.col("x"), breaks, labels)) == [
        None, "[0]", "[0]", "[0]", "[1 - 5]", "[1 - 5]", "[6 - 10]", "[6 - 10]", None, None]
    assert values(df, cut(F.col("x"), breaks, labels, include_lowest=False))[:3] == [None, None, "[0]"]
    open_top = cut(F.col("x"), (0, 5, float("inf")), ("low", "high"))
    assert values(df, open_top) == [None, "low", "low", "low", "low", "low", "high", "high", "high", None]


def test_mixed_units(spark):
    df = spark.createDataFrame([(v,) for v in (101, 107, 201, 230, 888, 777, 999, 15, None)], "x int").coalesce(1)
    assert values(df, decode_units(F.col("x"), ALCOHOL_UNITS)) == [4, 28, 1, 30, 0, None, None, 15, None]
    assert values(df, decode_units(F.col("x"), [UnitRule(0, 50, factor=2)]))[-2:] == [30, None]


def test_ties_round_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, -0.5, -1.5, 2.675)], "x double").coalesce(1)
    assert values(df, round_even(F.col("x"))) == [0.0, 2.0, 2.0, 0.0, -2.0, 3.0]
    assert values(df, round_even(F.col("x"), 2))[-1] == 2.68


def test_rounding_reads_all_digits(spark):
    cases = [(0.123456785, 8, 0.12345678), (0.123456775, 8, 0.12345678), (3.4999999996, 0, 3.0), (2.5000000000001, 0, 3.0),
             (1e13, 0, 1e13), (12345678901234.5, 0, 12345678901234.0), (1.4e15, 2, 1.4e15), (1e300, 4, 1e300),
             (-0.15, 1, -0.2), (float("inf"), 2, float("inf")), (5e-324, 16, 0.0)]
    for number, digits, expected in cases:
        df = spark.createDataFrame([(number,)], "x double")
        assert values(df, round_even(F.col("x"), digits)) == [expected], (number, digits)
    assert values(spark.createDataFrame([(None,)], "x double"), round_even(F.col("x"))) == [None]
    with pytest.raises(ValueError):
        round_even(F.col("x"), 17)


def test_rules_are_applied_in_order(spark):
    x = F.col("x")
    df = codes(spark)
    assert values(df, sentinel_to_value(x, {88: 0, 0: 5})) == [None, 5, 77, 5]
    assert values(df, update(x, [(x == 88, 0), (lambda now: now == 0, 5)])) == [None, 5, 77, 5]
    assert values(df, update(x, [(x == 88, 0), (x == 0, 5)])) == [None, 0, 77, 5]


def test_no_bin_for_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (7.0,)], "x double").coalesce(1)
    assert values(df, cut(F.col("x"), (0, 5, float("inf")), ("low", "high"))) == [None, "high"]


def test_blank_is_missing(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "x string").coalesce(1)
    assert values(df, blank_to_null(F.col("x"))) == [None, "a", None]
