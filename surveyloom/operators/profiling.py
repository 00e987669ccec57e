"""Frequency tables and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.functions.levels import Levels
from surveyloom.operators.distribution import every_column, quantile, value_counts
from surveyloom.operators.joins import left_merge
from surveyloom.operators.running import running_totals
from surveyloom.sources.scratch import settle

# Values of a column whose counts a sketch follows; what is frequent is counted right if there are fewer values.
TRACKED = 1000

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def freq_table(df: DataFrame, *columns: str) -> DataFrame:
    """Count per value (or combination); a missing value is a group of its own."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency tables of many columns at once: one scan, one shuffle."""
    text = [F.col(c).cast("string").alias(c) for c in columns]
    return (df.select(*text).unpivot([], list(columns), "column", "value")
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def level_counts(df: DataFrame, levels: Mapping[str, Levels]) -> DataFrame:
    """Count per declared level of each column, levels without rows included."""
    counted = frequencies(df, list(levels)).withColumnRenamed("value", "level")
    declared = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(label).alias("level"), F.lit(i).alias("ord"))
                         for c, spec in levels.items() for i, label in enumerate(spec.labels, start=1)])
    grid = df.sparkSession.range(1).select(F.inline(declared))
    return left_merge(grid, counted, ["column", "level"]).fillna({"n": 0})


def infer_levels(df: DataFrame) -> DataFrame:
    """Distinct values of every text column with their alphabetical position."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    distinct = (df.select(*text).unpivot([], text, "column", "level").where("level is not null")
                .distinct().withColumn("one", F.lit(1)))
    ranked = running_totals(distinct, ["column"], "level", ["one"])
    return ranked.select("column", "level", F.col("one_run").alias("ord"))


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, centre, spread, range, distinct, valid and missing counts per column.

    A column without values has a row of missing statistics.  Distinct values
    are counted before any change of type.
    """
    n, value = F.col("n"), F.col("value")
    counted = settle(value_counts(df, columns))
    ranked = running_totals(counted, ["column"], "value", ["n"])
    # One row per column; once written, the planner knows that and does not shuffle the values to it.
    stats = settle(ranked.groupBy("column").agg(
        (F.sum(value * n) / F.sum("n")).alias("mean"), F.min("value").alias("min"), quantile(0.5).alias("median"),
        F.max("value").alias("max"), (quantile(0.75) - quantile(0.25)).alias("iqr"), F.sum("n").alias("n_valid")))
    total = df.agg(F.count("*").alias("rows")).scalar()
    # Second pass around the mean: subtracting large squares would lose digits.
    spread = (left_merge(counted, stats.select("column", "mean"), ["column"]).groupBy("column")
              .agg(F.sqrt(F.try_divide(F.sum((value - F.col("mean")) * (value - F.col("mean")) * n),
                                       F.sum(n) - 1)).alias("sd")))
    own = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "own")
    distinct = (own.where("own is not null").distinct().groupBy("column")
                .agg(F.count("*").alias("n_distinct")))
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, dict(df.dtypes)[c])])
    full = left_merge(every_column(df, columns), left_merge(left_merge(stats, spread, ["column"]), distinct, ["column"]),
                      ["column"]).fillna(0, ["n_distinct", "n_valid"])
    return full.select(
        "column", F.element_at(kinds, F.col("column")).alias("type"), "mean", "sd", "min", "median", "max", "iqr",
        F.try_divide("sd", "mean").alias("cv"), "n_distinct", "n_valid",
        (total - F.col("n_valid")).alias("n_missing"))


def profile(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All of a table's profile: numeric columns, top values of text columns, and repeated rows.

    Numeric columns have their statistics, all other columns of simple types
    their type and the ``k`` most frequent values; a table without columns of one
    sort has an empty frame for it.
    """
    sort = dict(df.dtypes)
    plain = [c for c in df.columns if not sort[c].startswith(("array", "map", "struct", "binary"))]
    numeric = [c for c in plain if sort[c] in NUMERIC or sort[c].startswith("decimal")]
    text = [c for c in plain if c not in numeric]
    none = df.limit(0).select(F.lit("").alias("column"))
    kinds = F.create_map(*[F.lit(x) for c in text for x in (c, sort[c])]) if text else None
    top = profile_topk(df, text, k).withColumn("type", F.element_at(kinds, F.col("column"))) if text else none
    return (profile_numeric(df, numeric) if numeric else none), top, duplicate_count(df)


def profile_topk(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column with their share of the valid rows.

    ``row_number() <= k`` lets Spark keep only ``k`` rows per task and column
    before the shuffle, so a column with very many values stays cheap.
    """
    counted = frequencies(df, columns)
    valid = counted.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n_valid"),
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    top = (counted.where("value is not null")
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return left_merge(top, valid, ["column"]).withColumn("share", F.col("n") / F.col("n_valid"))


def profile_sketches(df: DataFrame, by: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """A table ``by..., column, type, n, n_valid, moments and sketches`` of all columns of simple types, in one pass.

    Distinct values are counted by HLL sketches, frequent ones by a heavy-hitter
    summary and numbers besides by quantile sketches and moments; no value is
    shuffled.  Rows of several tables, days or groups are merged by ``merged_profiles``.
    """
    kinds = dict(df.dtypes)
    plain = [c for c in df.columns if c not in by and not kinds[c].startswith(("array", "map", "struct", "binary"))]

    def facts(c: str):
        own, number = F.col(c), kinds[c] in NUMERIC or kinds[c].startswith("decimal")
        value = own.cast("double") if number else F.lit(None).cast("double")
        finite = F.when(~F.isnan(value), value)
        return F.struct(
            F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count("*").alias("n"), F.count(own).alias("n_valid"),
            F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.min(value).alias("min"), F.max(value).alias("max"),
            F.hll_sketch_agg(own.cast("string")).alias("distinct"), F.kll_sketch_agg_double(finite).alias("ranks"),
            F.call_function("approx_top_k_accumulate", own.cast("string"), F.lit(tracked)).alias("frequent"))

    wide = df.groupBy(*by).agg(*[facts(c).alias(f"_{i}") for i, c in enumerate(plain)])
    return wide.select(*by, F.inline(F.array(*[f"_{i}" for i in range(len(plain))])))


def merged_profiles(sketches: DataFrame, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """One row per column: counts, about how many distinct values, moments, quartiles and the ``k`` most frequent values."""
    n = F.sum("n_valid")
    mean = F.try_divide(F.sum("total"), n)
    merged = sketches.groupBy(*by, "column", "type").agg(
        n.alias("n_valid"), (F.sum("n") - n).alias("n_missing"), mean.alias("mean"),
        F.when(mean.isNotNull(), F.sqrt(F.greatest(F.try_divide(F.sum("squares") - n * mean * mean, n - 1), F.lit(0.0)))).alias("sd"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.kll_merge_agg_double("ranks").alias("_ranks"),
        F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", F.col("frequent")), F.lit(k + 1)).alias("top"))
    some = F.kll_sketch_get_n_double("_ranks") > 0
    quartiles = {name: F.when(some, F.kll_sketch_get_quantile_double("_ranks", F.lit(p)))
                 for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return merged.withColumns({**quartiles, "top": F.slice(F.filter("top", lambda t: t["item"].isNotNull()), 1, k)}).drop("_ranks")


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row in full."""
    return (df.groupBy(*df.columns).agg((F.count("*") - 1).alias("extra"))
            .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_duplicates")))
