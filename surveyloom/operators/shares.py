"""Shares, rates and group means for exploring one outcome."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.joins import left_merge
from surveyloom.operators.profiling import freq_table


def share_within(table: DataFrame, amount: str, within: Sequence[str], name: str) -> DataFrame:
    """``amount`` divided by its total over each ``within`` group.

    The totals are joined back and not taken from a window, which would send
    a whole group through one task.
    """
    totals = table.groupBy(*within).agg(F.sum(amount).alias("_total"))
    return (left_merge(table, totals, within)
            .withColumn(name, F.try_divide(F.col(amount), F.col("_total"))).drop("_total"))


def row_share(df: DataFrame, x: str, outcome: str) -> DataFrame:
    """P(outcome | x)."""
    return share_within(freq_table(df, x, outcome), "n", [x], "share")


def balanced_share(df: DataFrame, x: str, outcome: str) -> DataFrame:
    """P(x | outcome) rescaled to add up to one within each x.

    This is the height of a filled bar chart of proportions per outcome: it
    answers as if the outcome classes were equally frequent.
    """
    prop = share_within(freq_table(df, x, outcome), "n", [outcome], "prop")
    return share_within(prop, "prop", [x], "share")


def within_group_share(df: DataFrame, group: str, member: str) -> DataFrame:
    return share_within(freq_table(df, group, member), "n", [group], "proportion")


def rate_by(df: DataFrame, bins: str, group: str, case: Column) -> DataFrame:
    """Cases of each group as a percentage of all rows of the bin.

    Totals and cases come from one aggregation over one scan.  A bin without
    any case stays, with a missing group and a missing rate.
    """
    cells = df.groupBy(bins, group).agg(F.count("*").alias("n"), F.count_if(case).alias("cases"))
    totals = cells.groupBy(bins).agg(F.sum("n").alias("total"))
    hit = cells.where("cases > 0").drop("n")
    return left_merge(totals, hit, [bins]).withColumn("percentage", F.col("cases") / F.col("total") * 100)


def group_rate(df: DataFrame, group: str, case: Column) -> DataFrame:
    """Rows, cases and case rate per group."""
    return (df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(case).alias("cases"))
            .withColumn("rate", F.col("cases") / F.col("total")))


def adjusted_proportion(df: DataFrame, group: str, part: str, case: Column) -> DataFrame:
    """Share of each part among the cases of a group, times the group's case rate."""
    among_cases = within_group_share(df.where(case), group, part)
    return (left_merge(among_cases, group_rate(df, group, case), [group])
            .withColumn("adjusted", F.col("proportion") * F.col("rate")))


def aggregate_formula(df: DataFrame, y: str, by: Sequence[str],
                      fn: Callable[[str], Column] = F.avg) -> DataFrame:
    """``fn(y)`` per group; rows missing ``y`` or a group value are left out.

    ``fn`` is any function from a column to an aggregate column.
    """
    return df.dropna(subset=[y, *by]).groupBy(*by).agg(fn(y).alias(y))


def group_mean(df: DataFrame, y: str, by: Sequence[str], where: Column | None = None) -> DataFrame:
    """Mean per group over the rows ``where`` holds; a missing group value is kept."""
    return (df if where is None else df.where(where)).groupBy(*by).agg(F.avg(y).alias(f"mean_{y}"))


def balanced_shares(df: DataFrame, xs: Sequence[str], outcome: str) -> DataFrame:
    """:func:`balanced_share` of many columns from one scan: ``column, value, outcome, n, prop, share``."""
    long = (df.select(outcome, *[F.col(x).cast("string").alias(x) for x in xs])
            .unpivot([outcome], list(xs), "column", "value").where("value is not null"))
    prop = share_within(freq_table(long, "column", "value", outcome), "n", ["column", outcome], "prop")
    return share_within(prop, "prop", ["column", "value"], "share")
