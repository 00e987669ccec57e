"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import whole_text
from surveyloom.sources.scratch import settle

BLOCK_BYTES = 4096


def _blocks(text: Column, block_bytes: int) -> Column:
    """The text's bytes in blocks of fixed size; an empty text is one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / block_bytes), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last),
                       lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _name_blocks(text: DataFrame, block_bytes: int) -> DataFrame:
    """(digest, name): an integer for every distinct block, in sorted order within its partition.

    Equal blocks are combined before the shuffle, so a block that a third of the
    table repeats arrives once per task.  Rows find the name of a block by its
    SHA-256, which spares a second shuffle of the texts; that is safe only while
    no two different blocks share a digest, and this is checked over all of them.
    """
    blocks = text.select(F.explode(_blocks(F.col("text"), block_bytes)).alias("block"))
    names = settle(blocks.distinct().sortWithinPartitions("block")
                   .select(F.sha2("block", 256).alias("digest"),
                           F.monotonically_increasing_id().alias("name")))
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        raise ArithmeticError("two different blocks have one SHA-256; use another block size")
    return names


def _name_pairs(current: DataFrame) -> DataFrame:
    """Replace the names at (2k, 2k + 1) of every row by one name of the pair at k."""
    odd = F.col("at").bitwiseAND(1) == 1
    pairs = settle(current.groupBy("row", "blocks", F.shiftright("at", 1).alias("at"))
                   .agg(F.max(F.when(~odd, F.col("name"))).alias("left"),
                        F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("right")))
    names = settle(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
                   .withColumn("name", F.monotonically_increasing_id()))
    return pairs.join(names, ["left", "right"]).select("row", "blocks", "at", "name")


def name_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, id, text_sha256, blocks, name): two rows have equal (blocks, name)
    exactly if their texts are equal.

    The distinct blocks of all texts are sorted into integer names.  Then names
    of adjacent blocks are paired and the distinct pairs are named in turn, until
    every text has one name; a text of n blocks leaves after ceil(log2 n) rounds.
    Texts of unlike numbers of blocks are never compared.  The distinct blocks of
    texts are shuffled once; all later rounds move integers.

    Null text counts as empty; null and repeated ids are told apart by ``row``;
    an empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    text = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    rows = settle(text.select(
        F.monotonically_increasing_id().alias("row"), "id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("text"), block_bytes), lambda b: F.sha2(b, 256)).alias("digests")))
    longest = rows.agg(F.max(F.size("digests"))).first()[0] or 1
    current = (rows.select("row", F.size("digests").alias("blocks"), F.posexplode("digests").alias("at", "digest"))
               .join(_name_blocks(text, block_bytes), "digest").select("row", "blocks", "at", "name"))
    named, reach = None, 1
    while True:
        single = current.where(F.col("blocks") <= reach).where(F.col("blocks") > reach // 2)
        single = single.select("row", "blocks", "name")
        named = single if named is None else named.unionByName(single)
        if reach >= longest:
            break
        current = settle(_name_pairs(current.where(F.col("blocks") > reach)))
        reach *= 2
    return rows.select("row", "id", "text_sha256").join(named, "row")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; a null id is smaller than
    any other, and of equal ids one row stays.  ``keep_id`` is the id of the row
    that stays.  Groups are totalled before the shuffle and joined back by name,
    where adaptive execution splits a hot name.
    """
    named = settle(name_documents(docs, id_column, text_column, block_bytes))
    # Written, so that both sides of the join are plain shuffles, which can be split.
    groups = settle(named.groupBy("blocks", "name").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["blocks", "name"]).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all columns.

    Rows of one id and one text are copies of each other, whatever their other
    columns hold; one of them stays.
    """
    groups = exact_groups(docs, id_column, text_column)
    staying = groups.where("kept").select(F.col("id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    marked = docs.withColumn("_sha", F.sha2(whole_text(text_column), 256))
    kept = marked.join(staying, F.col(id_column).eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")),
                       "left_semi")
    return kept.dropDuplicates([id_column, "_sha"]).select(*docs.columns)
