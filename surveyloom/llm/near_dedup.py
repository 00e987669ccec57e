"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.arrowtext import chunks
from surveyloom.llm.common import whole_text
from surveyloom.llm.superminhash import band_keys, mixed, shingle_sets, signatures
from surveyloom.sources.scratch import settle

SHINGLE_WORDS = 5
# Shared shingles per hundred of the union.
SIMILARITY = 75
# 32 bands of 4: a pair at the limit of similarity shares no band once in 190,000 times.
SIGNATURE, BAND_ROWS = 128, 4
# Members of a bucket that one round compares with the whole bucket.
PIVOTS = 1024
# From so many members on, a bucket of several components is thinned out before pairs are formed.
CROWD = 32
# Bits of a class's parity map, by which most pairs are known to be too different before they are formed.
PARITY_BITS = 2048
# Bits of the filter that keeps texts without candidates from being shuffled; 2 MB at most.
FILTER_BITS = 1 << 24


def _sketch(docs: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """row, id, mark, n_shingles, key (a fingerprint of the set), bands of each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                       F.xxhash64(whole_text(text_column)).alias("mark"), whole_text(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), shingle_words)
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            total = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).astype(np.int64)
            other = np.array([np.bitwise_xor.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets],
                             dtype=np.uint64).astype(np.int64)
            keys = band_keys(signatures(sets, SIGNATURE), BAND_ROWS)
            size = keys.shape[1]
            some = np.flatnonzero(counts)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, size, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("mark"), pa.array(counts),
                 pa.array(total), pa.array(other), bands],
                names=["row", "id", "mark", "n_shingles", "key_sum", "key_xor", "bands"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(work, f"row long, id {id_type}, mark long, n_shingles long, key_sum long, key_xor long, "
                                 "bands array<long>")


def _worth_reading(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose mark may be wanted, by a bitmap of fixed size; only those are shuffled afterwards."""
    def place(mark: str):
        return F.pmod(F.col(mark), F.lit(FILTER_BITS)) + 1

    bitmaps = wanted.groupBy(F.bitmap_bucket_number(place("mark")).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place("mark"))).alias("bits"))
    bit = F.bitmap_bit_position(place("mark"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1
    joined = texts.withColumn("part", F.bitmap_bucket_number(place("mark"))).join(F.broadcast(bitmaps), "part")
    return joined.where(on).drop("part", "bits")


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """(cls, pivots, shingles) of the wanted classes, from the text of the row that stands for each."""
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(whole_text(text_column)).alias("mark"),
                        whole_text(text_column).alias("text"))
    w = wanted.alias("w")
    found = _worth_reading(texts, wanted).alias("t").join(
        w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.mark") == F.col("w.mark"))).select("cls", "pivots", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), shingle_words)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("pivots"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["cls", "pivots", "shingles"])

    return found.mapInArrow(work, "cls long, pivots array<long>, shingles array<long>")


def _parity_maps(sets: DataFrame) -> DataFrame:
    """(cls, parities): for every bit, whether an odd number of the shingles fall on it, as 64-bit numbers.

    Each bit in which two maps differ stands for a shingle, or more, that only one of the sets has.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column("shingles")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(shingles.offsets.to_numpy()))
            place = shingles.flatten().to_numpy().astype(np.uint64) % np.uint64(PARITY_BITS)
            odd = np.bincount(owner * PARITY_BITS + place.astype(np.int64), minlength=batch.num_rows * PARITY_BITS) & 1
            words = np.packbits(odd.astype(np.uint8).reshape(batch.num_rows, -1), axis=1).view(np.int64)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * words.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.reshape(-1)))], names=["cls", "parities"])

    return sets.select("cls", "shingles").mapInArrow(work, "cls long, parities array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b) of the pairs (a, b, shingles of b) whose full sets are similar enough."""
    first = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("others"))
    both = F.size(F.array_intersect("shingles", "others"))
    counted = pairs.join(first, "a").select(
        "a", "b", both.alias("both"), (F.size("shingles") + F.size("others") - both).alias("union"))
    return counted.where(100 * F.col("both") >= similarity * F.col("union")).select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Union-find over tables: hook every root on the smallest root next to it, shorten the paths, repeat.

    ``labels`` has a root for every class; the number of rounds grows with the
    logarithm of the longest chain of links, and nothing is gathered.
    """
    while True:
        a = labels.select(F.col("cls").alias("a"), F.col("root").alias("root_a"))
        b = labels.select(F.col("cls").alias("b"), F.col("root").alias("root_b"))
        between = settle(links.join(a, "a").join(b, "b").where("root_a <> root_b")
                         .select(F.greatest("root_a", "root_b").alias("root"),
                                 F.least("root_a", "root_b").alias("up")).distinct())
        if between.isEmpty():
            return labels
        hooks = settle(between.groupBy("root").agg(F.min("up").alias("up")))
        while True:
            further = hooks.select(F.col("root").alias("up"), F.col("up").alias("top"))
            longer = hooks.join(further, "up", "left")
            if longer.where("top is not null").isEmpty():
                break
            hooks = settle(longer.select("root", F.coalesce("top", "up").alias("up")))
        labels = settle(labels.join(hooks, "root", "left").select("cls", F.coalesce("up", "root").alias("root")))


def _several_roots(members: DataFrame) -> DataFrame:
    """(bucket, members, largest) of the buckets that hold several components; largest: the root with most members."""
    sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    return settle(sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members"),
        F.max(F.struct("n", "root")).getField("root").alias("largest")).where("roots > 1").drop("roots"))


def _open_shingles(classes: DataFrame, similarity: int) -> DataFrame:
    """(cls, open) of the classes that can still be linked with another component of ``classes``.

    Only shingles that occur in several components can be shared across
    components.  A class of n shingles, ``open`` of them such, shares at most
    ``open`` of a union of at least n with any class of another component.
    """
    left = classes
    for _ in range(2):
        each = left.select("cls", "root", F.explode("shingles").alias("shingle"))
        shared = settle(each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                        .where("low < high").select("shingle"))
        counted = each.join(shared, "shingle").groupBy("cls").agg(F.count(F.lit(1)).alias("open"))
        left = settle(left.drop("open").join(counted, "cls")
                      .where(100 * F.col("open") >= similarity * F.size("shingles")))
    return left.select("cls", "open")


def _pairs_across(members: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs to compare in buckets of several components, and the members left for another round, if any.

    The largest component of a bucket waits; the members of the others are
    pivots, compared with everything outside their own component, so they have
    then met the whole bucket.  A pair is formed only in the first bucket that it
    shares, and only if the sizes, open shingles and parity maps allow for a link:
    linked sets differ in at most (n + m) * (100 - s) / (100 + s) shingles.
    """
    mixed_buckets = _several_roots(members)
    placed = settle(members.join(mixed_buckets, "bucket"))
    waiting = placed.where("root <> largest")
    # The smallest members first: so a later one has not met an earlier one yet.
    order = Window.partitionBy("bucket").orderBy("cls")
    first = waiting.withColumn("at", F.row_number().over(order))
    pivots = first.where(F.col("at") <= PIVOTS)
    p, m = pivots.alias("p"), placed.alias("m")
    most = F.least(F.col("m.open"), F.col("p.open"))
    possible = 100 * most >= similarity * (F.col("m.n") + F.col("p.n") - most)
    once = F.array_min(F.array_intersect(F.col("m.bands"), F.col("p.bands"))) == F.col("m.bucket")
    order_ = (F.col("m.root") == F.col("m.largest")) | (F.col("m.cls") > F.col("p.cls"))
    apart = F.aggregate(F.zip_with("m.parities", "p.parities", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
                        F.lit(0), lambda total, n: total + n)
    alike = apart * (100 + similarity) <= (F.col("m.n") + F.col("p.n")) * (100 - similarity)
    pairs = m.join(p, (F.col("m.bucket") == F.col("p.bucket")) & (F.col("m.root") != F.col("p.root"))
                   & order_ & possible & once & alike).select(F.col("m.cls").alias("a"), F.col("p.cls").alias("b"))
    crowded = mixed_buckets.where(F.col("members") > PIVOTS)
    if crowded.isEmpty():
        return pairs, None
    met = pivots.select("bucket", "cls")
    return pairs, placed.drop("members", "largest").join(met, ["bucket", "cls"], "left_anti")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                shingle_words: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Rows with the same set of shingles form a class at once and count as one
    from there on.  Classes that share a band of their signatures are candidates;
    a candidate pair is linked if the full sets have ``similarity`` hundredths of
    their union in common.  Every class is first compared with the smallest class
    of each of its buckets, which joins most groups with about as many comparisons
    as they have members.  Buckets that still hold several components are then
    gone through: in crowded ones classes that cannot reach another component,
    going by the shingles that several components have, are left out, and of the
    other pairs of candidates across components those are compared whose parity
    maps do not show that they differ in too much.  So no link between components
    is lost, and pairs within a component are not formed.

    ``component_id`` is the smallest id of the component; of its rows one stays,
    that of the smallest id, null ids last.  Texts without words, and null ones,
    are linked with nothing and stay.  Other columns are not read.
    """
    rows = settle(_sketch(docs, id_column, text_column, shingle_words))
    key = ["n_shingles", "key_sum", "key_xor"]
    classes = settle(rows.where("n_shingles > 0").groupBy(*key).agg(
        F.min("row").alias("cls"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"),
        F.min_by(F.struct("id", "mark", "bands"), "row").alias("own")))
    banded = classes.select("cls", F.explode("own.bands").alias("bucket"))
    shared = settle(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("pivot"))
                    .where("n > 1").select("bucket", "pivot"))
    buckets = settle(banded.join(shared, "bucket"))
    candidates = settle(buckets.groupBy("cls").agg(F.collect_set("pivot").alias("pivots")))
    wanted = settle(candidates.join(classes, "cls").select(
        "cls", F.col("own.id").alias("id"), F.col("own.mark").alias("mark"), F.array_remove("pivots", F.col("cls")).alias("pivots")))
    sets = settle(_sets(docs, wanted, id_column, text_column, shingle_words))

    # At most one pivot per band, each compared once.
    stars = sets.select(F.explode("pivots").alias("a"), F.col("cls").alias("b"), "shingles")
    sets = sets.drop("pivots")
    pivots = sets.join(buckets.select(F.col("pivot").alias("cls")).distinct(), "cls", "left_semi")
    labels = candidates.select("cls", F.col("cls").alias("root"))
    labels = _joined(labels, settle(_linked(stars, pivots, similarity)))

    members = settle(buckets.select("bucket", "cls").join(labels, "cls"))
    mixed_buckets = _several_roots(members)
    if not mixed_buckets.isEmpty():
        live = members.join(mixed_buckets, "bucket")
        crowd = live.where(F.col("members") >= CROWD).select("cls", "root").distinct()
        crowd_sets = settle(sets.join(crowd, "cls").dropDuplicates(["cls"]))
        reach = settle(_open_shingles(crowd_sets, similarity))
        facts = classes.select("cls", F.col("n_shingles").alias("n"), F.col("own.bands").alias("bands"))
        thinned = live.join(reach, "cls", "left").where((F.col("members") < CROWD) | F.col("open").isNotNull())
        maps = settle(_parity_maps(sets.join(thinned.select("cls").distinct(), "cls", "left_semi")))
        left = settle(thinned.join(facts, "cls").join(maps.dropDuplicates(["cls"]), "cls").select(
            "bucket", "cls", "root", "n", "bands", "parities",
            F.when(F.col("members") < CROWD, F.col("n")).otherwise(F.col("open")).alias("open")))
        while left is not None:
            pairs, left = _pairs_across(left, similarity)
            chosen = sets.select(F.col("cls").alias("b"), "shingles")
            labels = _joined(labels, settle(_linked(settle(pairs).join(chosen, "b"), sets, similarity)))
            if left is not None:
                left = settle(left.drop("root").join(labels, "cls"))

    rooted = classes.select(*key, "cls", "least").join(labels, "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    tops = settle(rooted.groupBy("root").agg(F.min("least").alias("top")))
    placed = settle(rooted.join(tops, "root").select(*key, "top"))
    full = rows.drop("bands").join(placed, key, "left")
    alone = F.col("top").isNull()
    return full.select(
        "id", "mark", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all columns.

    Rows of one id and one text are copies of each other, whatever their other
    columns hold; one of them stays if they have words.
    """
    gone = near_groups(docs, id_column, text_column, **options)
    kept = gone.groupBy("id", "mark").agg(F.max("kept").alias("stays"), F.max("n_shingles").alias("n")).where("stays")
    kept = kept.select(F.col("id").alias("_keep_id"), F.col("mark").alias("_keep_mark"), (F.col("n") > 0).alias("_one"))
    same = F.col(id_column).eqNullSafe(F.col("_keep_id")) & (F.col("_mark") == F.col("_keep_mark"))
    marked = docs.withColumn("_mark", F.xxhash64(whole_text(text_column))).join(kept, same)
    worded = marked.where("_one").dropDuplicates([id_column, "_mark"])
    return worded.select(*docs.columns).unionByName(marked.where("not _one").select(*docs.columns))
