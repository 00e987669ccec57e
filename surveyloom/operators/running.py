"""Running totals over a globally ordered table, without a one-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.sources.scratch import settle

# Most rows that one task orders, and least for which another task is worth while.
BLOCK_ROWS, LEAST_ROWS = 1_000_000, 1_000


def running_totals(table: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                   descending: bool = False, block_rows: int | None = None) -> DataFrame:
    """Add, for every summed column ``s``, ``s_run`` (total up to and including
    the row) and ``s_all`` (total of the group), and ``next_value``, the order
    value of the following row.

    ``table`` holds one row per (``by``, ``order``) pair, as a ``groupBy`` gives.
    It is split into ordered blocks by range, as many as the session has shuffle
    partitions, or more if one would hold over ``BLOCK_ROWS`` rows (or of
    ``block_rows`` rows, if given).  Each block is totalled, and every block starts from the total of the blocks before
    it; a group of any size is spread over as many tasks as it needs.
    """
    table = settle(table)
    rows = table.count()
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (math.ceil(rows / block_rows) if block_rows else
              max(math.ceil(rows / BLOCK_ROWS), min(parts, math.ceil(rows / LEAST_ROWS)))) or 1
    direction = F.desc if descending else F.asc
    # The block number must be the same for both readers below, hence the copy.
    ranged = settle(table.repartitionByRange(blocks, *[F.asc(c) for c in by], direction(order))
                    .withColumn("_block", F.spark_partition_id()))
    return _join_blocks(ranged, by, order, sums, descending)


def _join_blocks(ranged: DataFrame, by: Sequence[str], order: str, sums: Sequence[str],
                 descending: bool) -> DataFrame:
    direction = F.desc if descending else F.asc
    first = F.max(order) if descending else F.min(order)
    per_block = ranged.groupBy(*by, "_block").agg(
        *[F.sum(s).alias(s) for s in sums], first.alias("_first"))
    # At most one row per (group, block): small however large the table is.
    group = Window.partitionBy(*by)
    along = group.orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    heads = per_block.select(
        *by, "_block", F.lit(None).cast(ranged.schema[order].dataType).alias(order),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).cast(ranged.schema[s].dataType).alias(s)
          for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_all") for s in sums],
        F.lead("_first").over(along).alias("_next_first"),
        F.lit(1).alias("_head"))
    # The head row of a block carries what the block needs to know about the
    # others and sorts before its rows, so the running sum starts from it.
    stacked = ranged.withColumn("_head", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    block = Window.partitionBy(*by, "_block")
    inside = block.orderBy(F.desc("_head"), direction(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [c for c in ranged.columns if c != "_block"]
    return (stacked
            .select(*kept, "_head",
                    *[F.sum(s).over(upto).alias(f"{s}_run") for s in sums],
                    *[F.max(f"{s}_all").over(block).alias(f"{s}_all") for s in sums],
                    F.coalesce(F.lead(order).over(inside),
                               F.max("_next_first").over(block)).alias("next_value"))
            .where("_head = 0").drop("_head"))
