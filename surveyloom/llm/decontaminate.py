"""Benchmark decontamination with a broadcast hash set of test n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import ascii_lower, whole_text
from surveyloom.sources.scratch import settle

WINDOW = 13
# Windows in one broadcast; about 200 bytes each, so some 20 MB.  A larger
# benchmark is searched in blocks of this size, each against all documents.
BLOCK_WINDOWS = 100_000
# Fixed value: what stands between words.
BETWEEN_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), "")


def _places(words: Column, width: int) -> Column:
    """How many windows of ``width`` words there are."""
    return F.greatest(F.size(words) - width + 1, F.lit(0))


def _starts(words: Column, width: int) -> Column:
    """1, 2, ... up to the last window of ``width`` words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(
        F.array().cast("array<int>"))


def _window_hashes(words: Column, width: int) -> Column:
    return F.transform(_starts(words, width), lambda i: F.xxhash64(F.slice(words, i, width)))


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
                      width: int = WINDOW) -> DataFrame:
    """(item, window, hash): the distinct windows of every item.

    An item of fewer than ``width`` words is one window of all its words; an
    item without words, or with null text, has none.  A null item id stays null.
    """
    words = benchmark.select(F.col(id_column).cast("string").alias("item"),
                             normal_words(whole_text(text_column)).alias("words")).where(F.size("words") > 0)
    long = F.transform(_starts(F.col("words"), width), lambda i: F.slice("words", i, width))
    windows = words.select("item", F.explode(
        F.when(F.size("words") < width, F.array("words")).otherwise(long)).alias("window"))
    return windows.distinct().withColumn("hash", F.xxhash64("window"))


def _found(docs: DataFrame, windows: DataFrame, widths: list[int], first: bool) -> DataFrame:
    """One row per verified hit, and with ``first`` one more per document, at place 0.

    The hashes of all windows of a document are exploded straight into the probe
    of the broadcast set, and only hits leave that stage; a hit counts if the
    words themselves are equal.
    """
    words = F.col("words")
    hashes = [_window_hashes(words, w) for w in widths]
    rows = docs.select("id", "mark", "words", F.posexplode(
        F.concat(F.array(F.lit(None).cast("bigint")), *hashes)).alias("place", "hash"))
    # The place in the row of hashes tells the width of a window and where it starts.
    start, before = None, F.lit(0)
    for w in widths:
        inside = F.col("place") <= before + _places(words, w)
        here = F.col("place") - before
        start = F.when(inside, here) if start is None else start.when(inside, here)
        before = before + _places(words, w)
    joined = rows.join(F.broadcast(windows), "hash", "left")
    exact = F.slice(words, F.greatest(start, F.lit(1)), F.greatest(F.size("window"), F.lit(0))) == F.col("window")
    kept = exact if not first else (F.col("place") == 0) | exact
    return joined.where(kept).select("id", "mark", F.size("words").cast("bigint").alias("n_words"),
                                     (F.col("place") == 0).alias("own"), start.alias("start"),
                                     F.size("window").alias("width"), "item")


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text", width: int = WINDOW,
                  share: float = 0.05, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: id, mark (hash of the text), n_words, n_hit,
    spans (word ranges hit: start from 0, end exclusive), items, n_items,
    contaminated.

    Every window of every text is looked up in a broadcast hash set of the
    benchmark's windows, and hits are verified on the words.  A document is
    contaminated if at least ``share`` of its words lie in a hit window.

    Null and empty texts have no words and no hits.  Rows of equal id and text
    have equal results, one for each row.  Items without id mark words but are
    not listed.  An empty benchmark hits nothing.  Other columns are not read.
    """
    windows = settle(benchmark_windows(benchmark, item_column, item_text_column, width))
    widths = sorted((r[0] for r in windows.select(F.size("window")).distinct().collect()), reverse=True) or [width]
    blocks = max(1, math.ceil(windows.count() / block_windows))
    text = docs.select(F.col(id_column).alias("id"), F.xxhash64(whole_text(text_column)).alias("mark"),
                       normal_words(whole_text(text_column)).alias("words"))
    found = None
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod("hash", F.lit(blocks)) == block)
        rows = _found(text, part, widths, first=block == 0)
        found = rows if found is None else found.unionByName(rows)
    per_row = found.groupBy("id", "mark", "n_words").agg(
        F.count(F.when(F.col("own"), 1)).alias("rows"),
        F.array_sort(F.collect_set(F.when(~F.col("own"), F.struct("start", "width")))).alias("places"),
        F.array_sort(F.collect_set(F.when(~F.col("own"), F.col("item")))).alias("items"))
    # Overlapping windows are merged from left to right.
    spans = F.aggregate(
        "places", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, p: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= p["start"] - 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], p["start"] - 1 + p["width"]).alias("end"))))
        ).otherwise(F.concat(done, F.array(F.struct(
            (p["start"] - 1).alias("start"), (p["start"] - 1 + p["width"]).alias("end"))))))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    full = per_row.withColumn("spans", spans).withColumn("n_hit", hit)
    per = 1 / share
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).select(
        "id", "mark", "n_words", "n_hit", "spans", "items", F.size("items").cast("bigint").alias("n_items"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns."""
    found = contamination(docs, benchmark, id_column, text_column, **options).where("contaminated")
    bad = found.select(F.col("id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    marked = docs.withColumn("_mark", F.xxhash64(whole_text(text_column)))
    same = F.col(id_column).eqNullSafe(F.col("_bad_id")) & (F.col("_mark") == F.col("_bad_mark"))
    return marked.join(bad, same, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 **options) -> DataFrame:
    """``docs`` with the hit words taken out of the text.

    A text with hits keeps its other words as written, with what follows each;
    the other texts stay as they are, null included.
    """
    found = contamination(docs, benchmark, id_column, text_column, **options).where("n_hit > 0")
    spans = found.select(F.col("id").alias("_hit_id"), F.col("mark").alias("_hit_mark"), "spans").dropDuplicates(
        ["_hit_id", "_hit_mark"])
    # Each word with what follows it, after whatever precedes the first word.
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    pieces = F.regexp_extract_all(whole_text(text_column), F.lit(f"{word}[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*"), F.lit(0))
    head = F.regexp_extract(whole_text(text_column), "^[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]*", 0)
    left = F.array_join(F.filter(F.col("_pieces"), lambda _, i: ~F.exists(
        "spans", lambda s: (s["start"] <= i) & (i < s["end"]))), "")
    same = F.col(id_column).eqNullSafe(F.col("_hit_id")) & (F.col("_mark") == F.col("_hit_mark"))
    joined = docs.withColumn("_mark", F.xxhash64(whole_text(text_column))).join(spans, same, "left")
    cleaned = joined.withColumn("_pieces", F.when(F.col("spans").isNotNull(), pieces)).withColumn(
        "_text", F.when(F.col("spans").isNull(), F.col(text_column)).otherwise(F.concat(head, left)))
    return cleaned.select(*[F.col("_text").alias(c) if c == text_column else F.col(c) for c in docs.columns])
