import math

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import metrics, sampling


def people(spark, n=1000, parts=4):
    return (spark.range(n, numPartitions=parts)
            .select(F.col("id").alias("resp_id"),
                    F.when(F.col("id") % 10 == 0, "Yes").otherwise("No").alias("hd")))


def ids(df):
    return sorted(r.resp_id for r in df.select("resp_id").collect())


def test_split_has_exact_sizes_and_ignores_partitioning(spark):
    split = sampling.split_stratified(people(spark), "hd", "resp_id", 0.7)
    counts = {(r.hd, r.train): r["count"] for r in split.groupBy("hd", "train").count().collect()}
    assert counts == {("Yes", True): 70, ("Yes", False): 30, ("No", True): 630, ("No", False): 270}
    again = sampling.split_stratified(people(spark, parts=13).repartition(5), "hd", "resp_id", 0.7)
    assert ids(split.where("train")) == ids(again.where("train"))
    other = sampling.split_stratified(people(spark), "hd", "resp_id", 0.7, seed=201)
    assert ids(split.where("train")) != ids(other.where("train"))


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_cells_with_many_rows_are_cut_exactly(spark, monkeypatch, digits):
    """Few cells put many rows into the one that is cut."""
    exact = sampling.split_stratified(people(spark), "hd", "resp_id", 0.7).where("train")
    monkeypatch.setattr(sampling, "CELL_DIGITS", digits)
    assert ids(sampling.split_stratified(people(spark), "hd", "resp_id", 0.7).where("train")) == ids(exact)


def test_a_large_cell_is_cut_again(spark, monkeypatch):
    """One digit a step and two rows a task: the cell of the last row is cut three times at least."""
    exact = sampling.split_stratified(people(spark, 5000), "hd", "resp_id", 0.7).where("train")
    steps, cells = [], sampling._cells

    def counted(rows, strata, step):
        steps.append((step, rows))
        return cells(rows, strata, step)

    monkeypatch.setattr(sampling, "_cells", counted)
    monkeypatch.setattr(sampling, "CELL_DIGITS", 1)
    monkeypatch.setattr(sampling, "ORDERED_ROWS", 2)
    assert ids(sampling.split_stratified(people(spark, 5000), "hd", "resp_id", 0.7).where("train")) == ids(exact)
    assert [step for step, _ in steps] == list(range(len(steps))) and len(steps) >= 3
    # Each step reads only what lies in the cell of the one before it.
    counts = [rows.count() for _, rows in steps]
    assert all(later <= max(earlier / 8, 20) for earlier, later in zip(counts, counts[1:]))


def test_balance_keeps_every_minority_row(spark):
    kept = sampling.balance(people(spark), "hd", "Yes", "resp_id", ratio=2)
    assert {r.hd: r["count"] for r in kept.groupBy("hd").count().collect()} == {"Yes": 100, "No": 200}


def test_balance_within_parts_and_short_majority(spark):
    df = people(spark, 300).withColumn("train", F.col("resp_id") < 100)
    kept = sampling.balance(df, "hd", "Yes", "resp_id", ratio=20, within=["train"])
    counts = {(r.train, r.hd): r["count"] for r in kept.groupBy("train", "hd").count().collect()}
    assert counts == {(True, "Yes"): 10, (True, "No"): 90, (False, "Yes"): 20, (False, "No"): 180}


def test_nothing_and_everything(spark):
    for ratio, expected in ((0.0, 0), (1.0, 1000)):
        assert sampling.split_stratified(people(spark), "hd", "resp_id", ratio).where("train").count() == expected


def test_missing_class_is_a_stratum(spark):
    df = people(spark, 100).withColumn("hd", F.when(F.col("resp_id") < 40, F.col("hd")))
    split = sampling.split_stratified(df, "hd", "resp_id", 0.5)
    assert split.where("hd is null and train").count() == 30


# Published matrices: (no->no, no->yes, yes->no, yes->yes) and accuracy.
GOLDEN = {
    "logistic test": ((8365, 2837, 1319, 4282), 0.7526632),
    "logistic train": ((19355, 6781, 3120, 9948), 0.747449239873482),
    "tree test": ((9524, 1678, 2261, 3340), 0.7655776),
    "forest out of bag": ((22254, 3882, 5742, 7326), 1 - 0.2454852),
    "forest test": ((9659, 1543, 2399, 3202), 0.765399),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_published_matrices(spark, name):
    cells, expected = GOLDEN[name]
    pairs = [("No", "No"), ("No", "Yes"), ("Yes", "No"), ("Yes", "Yes")]
    counted = spark.createDataFrame([(*p, n) for p, n in zip(pairs, cells)], "hd string, predicted string, n int")
    df = counted.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    assert math.isclose(metrics.accuracy(df, "hd", "predicted").first()[0], expected, abs_tol=2e-6)
    matrix = metrics.confusion(df, "hd", "predicted", ["No", "Yes"])
    assert {(r.actual, r.predicted): r.n for r in matrix.collect()} == dict(zip(pairs, cells))
    assert math.isclose(metrics.cell_proportions(matrix).agg(F.sum("prop")).first()[0], 1.0)
    errors = {r.actual: r.class_error for r in metrics.class_error(matrix).collect()}
    if name == "forest out of bag":
        assert math.isclose(errors["No"], 0.1485308, abs_tol=1e-7)
        assert math.isclose(errors["Yes"], 0.4393939, abs_tol=1e-7)


def test_empty_cells_are_zero(spark):
    df = spark.createDataFrame([("No", "No")], "a string, p string")
    matrix = metrics.confusion(df, "a", "p", ["No", "Yes"])
    assert {(r.actual, r.predicted): r.n for r in matrix.collect()} == {
        ("No", "No"): 1, ("No", "Yes"): 0, ("Yes", "No"): 0, ("Yes", "Yes"): 0}


@pytest.mark.parametrize("block_rows", [None, 3])
def test_roc_with_ties_across_classes(spark, block_rows):
    data = [(0.1, "No"), (0.4, "No"), (0.4, "Yes"), (0.35, "Yes"), (0.8, "Yes"), (0.8, "No"), (0.9, "Yes"),
            (0.05, "No"), (None, "Yes"), (0.5, "No"), (0.6, "Yes")]
    df = spark.createDataFrame(data, "s double, hd string")
    known = [(s, h == "Yes") for s, h in data if s is not None]
    scores = sorted({s for s, _ in known})
    cuts = [-math.inf, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], math.inf]
    yes = [s for s, y in known if y]
    no = [s for s, y in known if not y]
    expected = [(t, sum(s >= t for s in yes) / len(yes), sum(s < t for s in no) / len(no)) for t in cuts]
    curve = metrics.roc_curve(df, "s", F.col("hd") == "Yes", block_rows)
    got = sorted(tuple(r) for r in curve.collect())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(math.isclose(x, y, abs_tol=1e-12) or x == y for x, y in zip(a, b))
    wins = sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))
    assert math.isclose(metrics.auc(df, "s", F.col("hd") == "Yes", block_rows).first()[0], wins)
    best = min(expected, key=lambda p: ((1 - p[1]) ** 2 + (1 - p[2]) ** 2, p[0]))
    assert metrics.best_threshold(curve).first().threshold == best[0]
