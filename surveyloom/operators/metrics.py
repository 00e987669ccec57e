"""Classification metrics: contingency tables, accuracy, ROC curve, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.joins import left_merge
from surveyloom.operators.running import running_totals


def confusion(df: DataFrame, actual: str, predicted: str, levels: Sequence[str]) -> DataFrame:
    """Count per (actual, predicted) pair of declared levels, empty cells included."""
    counted = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"))
                      for a in levels for p in levels])
    grid = df.sparkSession.range(1).select(F.inline(cells))
    return left_merge(grid, counted, ["actual", "predicted"]).fillna({"n": 0})


def cell_proportions(matrix: DataFrame) -> DataFrame:
    total = matrix.agg(F.sum("n").alias("t")).scalar()
    return matrix.withColumn("prop", F.try_divide(F.col("n"), total))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def class_error(matrix: DataFrame) -> DataFrame:
    """Share of each actual class that was predicted as something else."""
    wrong = F.sum(F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy("actual").agg(
        F.sum("n").alias("n"), wrong.alias("wrong"), F.try_divide(wrong, F.sum("n")).alias("class_error"))


def _ranked_scores(df: DataFrame, score: str, positive: Column, block_rows: int | None) -> DataFrame:
    """Positives and negatives per distinct score with their running totals from the top."""
    counted = (df.where(F.col(score).isNotNull() & positive.isNotNull())
               .groupBy(F.col(score).alias("score"))
               .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))
    return running_totals(counted, [], "score", ["pos", "neg"], descending=True, block_rows=block_rows)


def roc_curve(df: DataFrame, score: str, positive: Column, block_rows: int | None = None) -> DataFrame:
    """Sensitivity and specificity at the midpoints between distinct scores and at both infinities."""
    ranked = _ranked_scores(df, score, positive, block_rows)
    points = ranked.select(
        F.when(F.col("next_value").isNull(), F.lit(float("-inf")))
        .otherwise((F.col("score") + F.col("next_value")) / 2).alias("threshold"),
        F.try_divide("pos_run", "pos_all").alias("sensitivity"),
        (1 - F.try_divide("neg_run", "neg_all")).alias("specificity"))
    top = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                          F.lit(0.0).alias("sensitivity"), F.lit(1.0).alias("specificity"))
    return points.unionByName(top)


def auc(df: DataFrame, score: str, positive: Column, block_rows: int | None = None) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, so ties count half."""
    ranked = _ranked_scores(df, score, positive, block_rows)
    above = F.col("pos_run") - F.col("pos") / 2
    pairs = F.max("pos_all").cast("double") * F.max("neg_all")
    return ranked.agg(F.try_divide(F.sum(F.col("neg") * above), pairs).alias("auc"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The ROC point closest to the top left corner; the lowest threshold on a tie."""
    miss = (1 - F.col("sensitivity")) * (1 - F.col("sensitivity"))
    false_alarm = (1 - F.col("specificity")) * (1 - F.col("specificity"))
    point = F.struct("threshold", "sensitivity", "specificity")
    return curve.agg(F.min_by(point, F.struct(miss + false_alarm, F.col("threshold"))).alias("p")).select("p.*")
