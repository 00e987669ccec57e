"""Exact-size, reproducible sampling.

Rows are ordered by the MD5 of their id and a seed.  That order does not
depend on partitioning, and a sample of exactly ``k`` rows is "everything up to
the k-th key".  The k-th key is found without sorting a class: rows are counted
per leading hex digits of the key, the counts show in which cell the k-th row
lies, and the rows of that one cell are counted by the next digits, until they
are few enough for one task to order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.functions.numeric import round_even
from surveyloom.operators.joins import attach, left_merge
from surveyloom.sources.scratch import settle

CELL_DIGITS = 4  # 65,536 cells per class
KEY_DIGITS = 32  # of an MD5
# Rows of a cell that one task may order.
ORDERED_ROWS = 100_000

Quota = Callable[[DataFrame], DataFrame]


def _cell(step: int):
    return F.substring("_key", 1 + step * CELL_DIGITS, CELL_DIGITS)


def _cells(rows: DataFrame, strata: Sequence[str], step: int) -> DataFrame:
    """Rows per stratum and cell, and how many there are up to it."""
    cells = rows.groupBy(*strata, _cell(step).alias("_cell")).agg(F.count("*").alias("_rows"))
    upto = (Window.partitionBy(*strata).orderBy("_cell")  # 16 ** CELL_DIGITS cells at most
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.withColumn("_run", F.sum("_rows").over(upto))


def _edge(cells: DataFrame, wanted: DataFrame, strata: Sequence[str]) -> DataFrame:
    """One row per stratum: the cell that holds the k-th key, how many of its rows are needed, and how many it has."""
    return (left_merge(cells, wanted, strata).where("_run - _rows < _k and _k <= _run")
            .select(*strata, F.col("_cell").alias("_edge"), (F.col("_k") - F.col("_run") + F.col("_rows")).alias("_need"), "_rows"))


def mark_sample(df: DataFrame, strata: Sequence[str], id_column: str, seed: int | str, quota: Quota,
                flag: str) -> DataFrame:
    """Add a boolean column that is true for exactly ``k`` rows per stratum.

    ``quota`` receives one row per stratum with its size ``n`` and adds ``k``.
    The table itself is never shuffled: it is scanned for the counts, for the
    one cell per stratum, and for the result.  A cell that is too large for one
    task is cut into cells itself.  Ids must be unique: rows that share one are taken together.
    """
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))))
    cells = _cells(keyed, strata, 0)
    sizes = cells.groupBy(*strata).agg(F.sum("_rows").alias("n"))
    wanted = quota(sizes).select(*strata, F.least("k", "n").cast("bigint").alias("_k"))
    near, step = keyed.select(*strata, "_key", F.col(id_column).alias("_id")), 0
    edge = settle(_edge(cells, wanted, strata))
    while True:
        near = left_merge(near, edge.drop("_rows"), strata).where(_cell(step) == F.col("_edge")).drop("_edge")
        most = edge.agg(F.max("_rows")).first()[0] or 0
        step += 1
        if most <= ORDERED_ROWS or not 0 < step * CELL_DIGITS < KEY_DIGITS:
            break
        near = settle(near)
        edge = settle(_edge(_cells(near, strata, step), edge.select(*strata, F.col("_need").alias("_k")), strata))
        near = near.drop("_need")
    order = Window.partitionBy(*strata).orderBy("_key", "_id")
    last = (near.withColumn("_at", F.row_number().over(order)).where("_at = _need")
            .select(*strata, F.col("_key").alias("_last_key"), F.col("_id").alias("_last_id")))
    picked = ((F.col("_key") < F.col("_last_key"))
              | ((F.col("_key") == F.col("_last_key")) & (F.col(id_column) <= F.col("_last_id"))))
    return (attach(keyed, last, strata)
            .withColumn(flag, F.coalesce(picked, F.lit(False)))
            .select(*df.columns, flag))


def split_stratified(df: DataFrame, label: str, id_column: str, ratio: float = 0.7,
                     seed: int | str = 200, flag: str = "train") -> DataFrame:
    """Mark ``round(ratio * n)`` rows of every class for training."""
    return mark_sample(df, [label], id_column, seed,
                       lambda sizes: sizes.withColumn("k", round_even(F.col("n") * F.lit(ratio))), flag)


def balance(df: DataFrame, label: str, minority: str, id_column: str, ratio: int = 2,
            seed: int | str = 200, within: Sequence[str] = ()) -> DataFrame:
    """Keep all minority rows and exactly ``ratio`` times as many of each other class.

    ``within`` balances several parts (such as a train and a test set) at once.
    A class that is smaller than its quota is kept whole; rows without a label
    are left out.
    """
    def quota(sizes: DataFrame) -> DataFrame:
        is_minority = F.col(label) == minority
        part = Window.partitionBy(*within)
        few = F.sum(F.when(is_minority, F.col("n")).otherwise(0)).over(part)
        return sizes.withColumn("k", F.when(is_minority, F.col("n")).otherwise(few * ratio))

    marked = mark_sample(df.where(F.col(label).isNotNull()), [*within, label], id_column, seed, quota, "_kept")
    return marked.where("_kept").drop("_kept")
