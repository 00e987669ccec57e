"""Cleaning stages, audits and de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.nulls import blank_to_null, update
from surveyloom.operators.joins import scalars

Stage = Callable[[DataFrame], DataFrame]

COPIES_PER_TASK_ROW = 1_000_000


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Apply cleaning stages in order; the order matters for conditional means."""
    return reduce(lambda frame, stage: frame.transform(stage), stages, df)


def recode(columns: Mapping[str, Column]) -> Stage:
    """Set many columns in one projection."""
    return lambda df: df.withColumns(dict(columns))


def rename(mapping: Mapping[str, str]) -> Stage:
    return lambda df: df.withColumnsRenamed(dict(mapping))


def drop_missing(*columns: str) -> Stage:
    """Keep rows with an answer in every column; separate tests, so they can reach the file scan."""
    return lambda df: df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def assign(column: str, rules: Sequence[tuple[Column, Any]]) -> Stage:
    return lambda df: df.withColumn(column, update(F.col(column), rules))


def impute_mean(column: str, among: Column, where: Column) -> Stage:
    """Fill ``column`` where ``where`` holds with its mean over the rows ``among``.

    The mean is taken from the frame as it stands at this stage.
    """
    def stage(df: DataFrame) -> DataFrame:
        mean = scalars(df.where(among).agg(F.avg(column).alias("mean")))["mean"]
        return df.withColumn(column, update(F.col(column), [(where, mean)]))
    return stage


def blanks_to_null(df: DataFrame) -> DataFrame:
    text = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[blank_to_null(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def tally(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Count the rows that meet each condition, all in one scan.

    Returns ``step, name, n`` in the order of ``checks``.
    """
    counted = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("name"), F.col(f"c{i}").alias("n"))
                     for i, name in enumerate(checks)])
    return counted.select(F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    return tally(df, {c: F.col(c).isNull() for c in df.columns}).select(F.col("name").alias("column"), "n")


def range_audit(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows outside the plausible range of each column."""
    checks = {c: (F.col(c) < low) | (F.col(c) > high) for c, (low, high) in ranges.items()}
    return tally(df, checks).select(F.col("name").alias("column"), "n")


def attrition(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Rows left after each of the ordered filters, in one scan."""
    running, kept = {}, F.lit(True)
    for name, condition in filters.items():
        kept = kept & condition
        running[name] = kept
    return tally(df, running)


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_rows(df: DataFrame, copies_per_row: int = COPIES_PER_TASK_ROW) -> DataFrame:
    """The second and later copies of fully equal rows.

    Counting combines on the map side, so a row that makes up a third of the
    table arrives as one count.  Its copies are emitted in portions that are
    spread over tasks before they are expanded.
    """
    extra = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_extra")).where("_extra > 0")
    portions = extra.withColumn(
        "_portion", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                         F.expr(f"(_extra - 1) div {copies_per_row}"))))
    size = F.least(F.lit(copies_per_row), F.col("_extra") - F.col("_portion") * copies_per_row)
    spread = portions.repartition(*df.columns, "_portion")
    return (spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
            .select(*df.columns))
