"""Hard negatives by inner product, from Hilbert-ordered blocks chosen by interval bounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.hilbert import hilbert_keys
from surveyloom.sources.scratch import scratch_folder, settle

SCALE = 256
POSITIVES = NEGATIVES = 5
# A negative has 80 to 100 hundredths of the positive's score.
LEAST_SHARE, MOST_SHARE = 80, 100
# Rows of a candidate block, anchors that one pass carries along, and rows scored against them at a time.
BLOCK_ROWS, ANCHORS, BATCH_ROWS = 32_768, 2048, 4096
# Rows from which on another block is worth while, as long as the session has tasks for it.
LEAST_ROWS = 1024
# Bits per component of the place on the curve.
CURVE_BITS = 4
# Whole numbers up to here are exact as doubles.
EXACT = 2 ** 53


def usable(vectors: DataFrame, vector_column: str, label_column: str) -> DataFrame:
    """Rows with a label and a vector of numbers only."""
    bad = F.exists(F.col(vector_column), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return vectors.where(F.col(label_column).isNotNull() & F.col(vector_column).isNotNull() & ~bad)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


# ---- candidate blocks

def write_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The candidates as Parquet, one folder a block, in the order of a Hilbert curve; and the blocks' zone map.

    ``rows`` has id, label, vector (whole numbers).  The zone map has a row per
    block: block, labels, low and high per dimension.  Shorter vectors go on with zeros.
    """
    rows = settle(rows)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"),
                     F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    width, low, high = facts.width or 0, facts.low or 0, facts.high or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                matrix = matrix_of(part.column("vector"), width).astype(np.float64)
                span = max(float(high) - float(low), 1.0)
                cells = np.minimum((matrix - low) / span * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.uint8)
                keys = hilbert_keys(cells, CURVE_BITS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, "place"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(facts.n / block_rows), min(parts, math.ceil(facts.n / LEAST_ROWS)), 1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{kinds}, place binary")
    # Equal vectors have one place; by id they are still spread over blocks.
    order = ["place", F.col("id").isNull(), "id"]
    ranged = placed.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    path = scratch_folder(rows.sparkSession)
    (ranged.withColumn("block", F.spark_partition_id()).drop("place")
     .write.partitionBy("block").parquet(path))
    candidates = rows.sparkSession.read.schema(f"{kinds}, block int").parquet(path)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, highs, labels = {}, {}, {}
        for batch in batches:
            matrix, block = matrix_of(batch.column("vector"), width), batch.column("block").to_numpy()
            label = np.array(batch.column("label").to_pylist(), dtype=object)
            for b in np.unique(block).tolist():
                mine = matrix[block == b]
                lows[b] = np.minimum(lows.get(b, mine[0]), mine.min(axis=0))
                highs[b] = np.maximum(highs.get(b, mine[0]), mine.max(axis=0))
                labels.setdefault(b, set()).update(label[block == b].tolist())
        if lows:
            yield pa.RecordBatch.from_pylist(
                [{"block": b, "low": lows[b].tolist(), "high": highs[b].tolist(), "labels": sorted(labels[b])} for b in lows],
                schema=shape)

    label_kind = rows.schema["label"].dataType.simpleString()
    schema = f"block int, low array<long>, high array<long>, labels array<{label_kind}>"
    shape = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    # A block may be read in several parts: their bounds are joined.
    parts = candidates.select("block", "vector", "label").mapInArrow(bounds, schema)
    by_place = parts.select("block", "labels", F.posexplode(F.arrays_zip("low", "high")).alias("d", "z"))
    merged = by_place.groupBy("block", "d").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
    sides = merged.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("z"))
    named = parts.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    zones = named.join(sides, "block", "left").select(
        "block", "labels", F.coalesce("z.low", F.array().cast("array<long>")).alias("low"),
        F.coalesce("z.high", F.array().cast("array<long>")).alias("high"))
    return candidates, settle(zones)


def matrix_of(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of one width, filled up with zeros."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    matrix = np.zeros((len(sizes), width), np.int64)
    matrix[np.arange(width)[None, :] < sizes[:, None]] = values
    return matrix


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows: by doubles, 64-bit numbers or Python's own, whichever holds them."""
    def size(m: np.ndarray) -> int:
        return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    most = size(a) * size(b) * max(a.shape[1], 1)
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    kind = np.int64 if most < 2 ** 62 else object
    return a.astype(kind) @ b.astype(kind).T


def score_bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner product of each vector with any vector between ``low`` and ``high``, by interval arithmetic."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    sides = np.stack([low, high])
    (up_low, up_high), (down_low, down_high) = products(up, sides).T, products(down, sides).T
    return up_low + down_high, up_high + down_low


# ---- windows

@dataclass(frozen=True)
class Windows:
    """For each anchor of a pass: which scores it wants, of rows with its own or with other labels.

    ``least`` and ``most`` have a row per anchor and a column per window; the best
    ``top`` rows of every window are wanted.  A window whose bounds cross is closed.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same_label: bool
    least: np.ndarray
    most: np.ndarray
    top: int

    def reach(self, low: np.ndarray, high: np.ndarray, labels: set) -> np.ndarray:
        """Which anchors have a window that a block with these bounds and labels may serve."""
        bottom, top = score_bounds(self.vectors, low, high)
        own = np.array([(x in labels) if self.same_label else bool(labels - {x}) for x in self.labels], dtype=bool)
        hit = (self.least <= self.most) & (top[:, None] >= self.least) & (bottom[:, None] <= self.most)
        return own & hit.any(axis=1)


def _blocks_to_read(zones: DataFrame, windows: Windows) -> list[int]:
    """Numbers of the blocks that some window of the pass must read."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [row["block"] for row in batch.to_pylist() if windows.reach(
                np.array(row["low"], np.int64), np.array(row["high"], np.int64), set(row["labels"])).any()]
            yield pa.RecordBatch.from_arrays([pa.array(read, pa.int32())], names=["block"])

    return [r.block for r in zones.mapInArrow(work, "block int").collect()]


def _best_rows(candidates: DataFrame, windows: Windows) -> DataFrame:
    """(anchor, window, id, score, rank): the best rows of each task for every window.

    Batches are scored block by block: anchors that no row of the batch can serve,
    going by the batch's own bounds and the worst row already held, are skipped.
    """
    width, anchor_ids = windows.vectors.shape[1], set(windows.ids.tolist()) if windows.same_label else set()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = windows.least.shape
        held: dict[tuple[int, int], list[tuple]] = {}
        floor = windows.least.copy()  # a window that is full wants nothing under its worst row
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                vectors = matrix_of(part.column("vector"), width)
                ids = part.column("id").to_pylist()
                coded = part.column("label").dictionary_encode()
                labels, code = coded.indices.to_numpy(), {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
                own = [j for j, i in enumerate(ids) if i in anchor_ids]
                bottom, top = score_bounds(windows.vectors, vectors.min(axis=0), vectors.max(axis=0)) if width else (
                    np.zeros(shape[0], np.int64),) * 2
                wanted = (floor <= windows.most) & (top[:, None] >= floor) & (bottom[:, None] <= windows.most)
                asked = np.flatnonzero(wanted.any(axis=1))
                scores = products(windows.vectors[asked], vectors)
                for row, anchor in zip(scores, asked):
                    fits = (labels == code.get(windows.labels[anchor], -1)) == windows.same_label
                    if windows.same_label:
                        fits[[j for j in own if ids[j] == windows.ids[anchor]]] = False
                    for window in np.flatnonzero(wanted[anchor]):
                        inside = np.flatnonzero(fits & (row >= floor[anchor, window]) & (row <= windows.most[anchor, window]))
                        if not len(inside):
                            continue
                        if len(inside) > 4 * windows.top:  # those that tie with the last that counts stay in
                            last = np.partition(row[inside], -windows.top)[-windows.top]
                            inside = inside[row[inside] >= last]
                        best = held.setdefault((int(anchor), int(window)), [])
                        best += [(-int(row[j]), ids[j] is None, ids[j] or 0) for j in inside]
                        best.sort()
                        del best[windows.top:]
                        if len(best) == windows.top:
                            floor[anchor, window] = max(floor[anchor, window], -best[-1][0])
        rows = [(a, w, None if missing else i, min(max(-s, -2 ** 63), 2 ** 63 - 1))
                for (a, w), best in held.items() for s, missing, i in best]
        for start in range(0, len(rows), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*rows[start:start + BATCH_ROWS]), arrow)], schema=arrow)

    kind = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    schema = f"anchor int, window int, id {kind['id']}, score long"
    arrow = candidates.sparkSession.createDataFrame([], schema).toArrow().schema
    found = candidates.mapInArrow(work, schema)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("id").isNull(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.top)


def _read(candidates: DataFrame, blocks: Sequence[int]) -> DataFrame:
    return candidates.where(F.col("block").isin(list(blocks)))


def mine(vectors: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding",
         label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
         least_share: int = LEAST_SHARE, most_share: int = MOST_SHARE,
         report: Callable[[int, int], None] | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    ``vectors`` holds whole numbers; ``is_anchor`` is a condition on the id column.
    Scores are exact inner products, higher ones first, ties by smaller id, null ids
    last.  Positives are the best ``positives`` other rows of the anchor's label;
    for each, the negatives are the best ``negatives`` rows of other labels whose
    score lies between ``least_share`` and ``most_share`` hundredths of the
    positive's.  So a positive with a negative score has none.

    Candidates lie in blocks of about ``BLOCK_ROWS`` rows in the order of a Hilbert
    curve.  Anchors go in passes of at most ``ANCHORS``, neighbours on the curve
    together: their home blocks give a first bound for the positives, the zone
    map then tells which blocks can hold a better one, and, once the positives are
    known, which blocks can hold scores inside a window.  Only those are read.

    Vectors of unequal length go on with zeros; scores outside 64 bits become the
    nearest number.  Rows that repeat an id are candidates each, but not positives of an anchor of
    that id; repeated anchors count once, the one with the least label and vector.
    An anchor without positives or negatives has no rows.  Other columns are not
    read.  ``report`` is told how many blocks each search reads, and of how many.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"),
                          F.col(vector_column).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    candidates, zones = write_blocks(rows)
    total = zones.count()
    width = zones.agg(F.max(F.size("low"))).first()[0] or 0
    # Least label and vector of an id; by block, so that a pass holds neighbours.
    anchors = candidates.where("asks and id is not null").groupBy("id").agg(
        F.min(F.struct("label", "vector", "block")).alias("a")).select("id", "a.*")
    anchors = settle(anchors)
    passes = math.ceil(anchors.count() / ANCHORS)
    dealt = settle(anchors.repartitionByRange(max(passes, 1), "block", "id").withColumn("pass", F.spark_partition_id()))
    path = scratch_folder(spark)
    shape = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    schema = f"anchor_id {shape['id']}, positive_id {shape['id']}, rank int, negative_id {shape['id']}, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)

    def search(windows: Windows) -> DataFrame:
        blocks = _blocks_to_read(zones, windows)
        if report is not None:
            report(len(blocks), total)
        return _best_rows(_read(candidates, blocks), windows)

    def one_pass(chosen: pa.Table) -> None:
        ids = np.array(chosen.column("id").to_pylist(), dtype=object)
        labels = np.array(chosen.column("label").to_pylist(), dtype=object)
        matrix = matrix_of(chosen.column("vector").combine_chunks(), width)
        lowest = np.full((len(ids), 1), np.iinfo(np.int64).min)
        highest = np.full((len(ids), 1), np.iinfo(np.int64).max)
        near = Windows(ids, labels, matrix, True, lowest, highest, positives)
        home = _best_rows(_read(candidates, sorted(set(chosen.column("block").to_pylist()))), near)
        least = lowest.copy()
        for r in home.where(F.col("rank") == positives).select("anchor", "score").collect():
            least[r.anchor, 0] = r.score
        near = Windows(ids, labels, matrix, True, least, highest, positives)
        found = search(near).select("anchor", "rank", "id", "score").collect()  # a few rows per anchor of the pass
        if not found:
            return
        low, high = np.full((len(ids), positives), 1), np.full((len(ids), positives), 0)  # closed
        for r in found:
            # Python's division rounds down: whole scores at or over, and at or under, the shares.
            low[r.anchor, r.rank - 1] = -(-least_share * r.score // 100)
            high[r.anchor, r.rank - 1] = most_share * r.score // 100
        far = Windows(ids, labels, matrix, False, low, high, negatives)
        partners = spark.createDataFrame([(r.anchor, r.rank - 1, ids[r.anchor], r.id, r.score) for r in found],
                                         f"anchor int, window int, anchor_id {shape['id']}, positive_id {shape['id']}, positive_score long")
        hard = search(far).join(F.broadcast(partners), ["anchor", "window"])  # at most ``positives`` rows per anchor of the pass
        hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")).write.mode("append").parquet(path)

    for number in range(passes):
        chosen = dealt.where(F.col("pass") == number).drop("pass").orderBy("block", "id").toArrow()
        for start in range(0, chosen.num_rows, ANCHORS):  # ranges are cut by a sample, and may come out larger
            one_pass(chosen.slice(start, ANCHORS))
    return spark.read.schema(schema).parquet(path)
