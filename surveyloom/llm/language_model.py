"""Language-model scores of texts from a probabilistic suffix tree learned on the corpus, held as tables."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from surveyloom.llm.arrowtext import chunks, coded, words_of
from surveyloom.llm.common import whole_text
from surveyloom.sources.scratch import settle

# The end of a text as a word; no word holds white space.
END = "\n"
# Taken off every count of a stored successor, for the successors that are not stored.
DISCOUNT = 0.75
# A context is tested if it was seen so often, and a successor stored in it if it was
# seen so often after it.  Both are counts, so the model grows with the corpus.
CONTEXT_SEEN, STORED_SEEN = 10, 2
DEPTH = 3
# Least share of all tokens of a string that tasks look up by themselves; all others are
# joined.  At most 1 / share strings of each length have it, and no key of the join does.
HOT_SHARE = 2e-6
# Bits of the maps that keep strings out of a shuffle which cannot count there.  Where two
# strings share a bit, one too many is shuffled, and the exact tables leave it out.
MAP_BITS = 1 << 26
# Bits a string sets in a map at most, and how far apart they are taken from its key.
MOST_MARKS, MARK_SHIFT = 3, 19
# Strings of a text chunk travel in blocks by the leading bits of their keys, one for about
# so many tokens of the corpus where strings are counted, and where they are looked up.
COUNTED_TOKENS, ASKED_TOKENS, LEAST_BLOCKS = 1_000_000, 2_000_000, 8
# Bytes of words hashed at a time.
HASHED_BYTES = 1 << 20
# Places by which the hash of a word is turned for each word after it.
_TURN = 13


def _written(df: DataFrame) -> DataFrame:
    """The table settled; the shuffle files behind it go with the driver's garbage."""
    table = settle(df)
    _collect(table)
    return table


def _collect(table: DataFrame) -> None:
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()


def _removed(table: DataFrame) -> None:
    """Remove a settled table that no table still to be read is made from."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any change over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words that are not empty: every byte is mixed with its place, and these numbers are added up."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    bytes_, sums = np.frombuffer(data, np.uint8), np.zeros(len(words), np.uint64)
    for start in range(int(edges[0]), int(edges[-1]), HASHED_BYTES):
        end = min(start + HASHED_BYTES, int(edges[-1]))
        first, last = np.searchsorted(edges, start, "right") - 1, np.searchsorted(edges, end, "left")
        begins = np.maximum(edges[first:last], start) - start
        place = np.arange(start, end) - np.repeat(edges[first:last], np.diff(np.append(begins, end - start)))
        marks = (place.astype(np.uint64) << np.uint64(8)) + bytes_[start:end] + np.uint64(1)
        sums[first:last] += np.add.reduceat(_mixed(marks * np.uint64(0x9E3779B97F4A7C15)), begins)
    return _mixed(sums + np.diff(edges).astype(np.uint64))


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, each text between two ends; places in the text; text numbers.

    The end before a text has place 0.
    """
    words, ends = words_of(texts)
    codes, distinct = coded(words)
    own = np.concatenate([_word_hashes(pa.array([END])), _word_hashes(distinct)])
    sizes = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), sizes + 2)
    first = np.concatenate([[0], np.cumsum(sizes + 2)])[:-1]
    place = np.arange(len(text)) - np.repeat(first, sizes + 2)
    hashes = np.full(len(text), own[0])
    inside = np.ones(len(text), bool)
    inside[first] = inside[first + sizes + 1] = False
    hashes[inside] = own[codes + 1]
    return hashes, place, text


def _strings(hashes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Keys of the strings of 1, 2, ... words that end at each place; at places before their length they say nothing."""
    key = hashes
    yield key
    for n in range(1, longest):
        key = key.copy()
        key[n:] ^= _turned(hashes[:len(hashes) - n], n)
        yield key


def _turned(hashes: np.ndarray, times: int) -> np.ndarray:
    return (hashes << np.uint64(_TURN * times)) | (hashes >> np.uint64(64 - _TURN * times))


def _bit_map(keys: DataFrame) -> tuple[int, np.ndarray]:
    """A map of some bits of each key, and their number; its size is bounded whatever the number of keys.

    The fewer the keys, the more bits each sets, so that few other strings have all of theirs set.
    """
    count = keys.count()
    marks = max(1, min(MOST_MARKS, round(math.log(2) * MAP_BITS / max(count, 1))))
    slots = F.array(*[F.shiftrightunsigned("key", MARK_SHIFT * i).bitwiseAND(MAP_BITS - 1) for i in range(marks)])
    words = keys.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS >> 6, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks, out


def _mapped(bit_map: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    marks, bits = bit_map
    found, at = np.zeros(len(keys), bool), np.arange(len(keys))
    for i in range(marks):
        slot = (keys[at] >> np.uint64(MARK_SHIFT * i)) & np.uint64(MAP_BITS - 1)
        at = at[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0]
    found[at] = True
    return found


def count_words(training: DataFrame) -> DataFrame:
    """key and n of all words and ends of the training texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, place, _ = _hashed(batch.column("text"))
            keys, times = np.unique(hashes[place > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "n"])

    return settle(training.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))


def _block_bits(tokens: int, each: int) -> int:
    return max(LEAST_BLOCKS, tokens // each).bit_length() - 1


def _successors(training: DataFrame, shorter: DataFrame, level: int, tokens: int, context_seen: int) -> DataFrame:
    """key, context, shorter, n of the strings of ``level`` words and a successor.

    ``shorter`` holds the strings of one word less.  A string can only count if
    its first words are a context and its last words are stored.  Chunks of
    texts count their strings, and those of a block come together in arrays.
    """
    context = training.sparkSession.sparkContext
    shared = context.broadcast((_bit_map(shorter.where(F.col("n") >= context_seen)), _bit_map(shorter.where(F.col("n") >= STORED_SEEN))))
    bits = _block_bits(tokens, COUNTED_TOKENS)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    # The key of two words follows from those of each.
    names = ["keys", "contexts", "shorter"][level == 1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, place, _ = _hashed(batch.column("text"))
            *_, below, whole = _strings(hashes, level + 1)
            contexts, stored = shared.value
            at = np.flatnonzero(place >= level)
            at = at[_mapped(stored, below[at])]
            at = at[_mapped(contexts, below[at - 1])]
            keys, some, times = np.unique(whole[at], return_index=True, return_counts=True)
            at = at[some]
            columns = [*[keys, below[at - 1], below[at]][level == 1:], times.astype(np.uint32)]
            ends = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), *(pa.array([x[ends[i]:ends[i + 1]].tobytes() for i in full], pa.binary()) for x in columns)],
                names=["block", *names, "times"])

    def counted(block: pa.Table) -> pa.Table:
        columns = [np.frombuffer(b"".join(block.column(c).to_pylist()), np.uint64) for c in names]
        keys = columns[0] if level > 1 else columns[1] ^ _turned(columns[0], 1)
        order = np.argsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        n = np.add.reduceat(np.frombuffer(b"".join(block.column("times").to_pylist()), np.uint32)[order].astype(np.int64), starts)
        often = n >= STORED_SEEN
        at = order[starts[often]]
        return pa.table({"key": keys[at].view(np.int64), "context": columns[-2][at].view(np.int64),
                         "shorter": columns[-1][at].view(np.int64), "n": n[often]})

    packed = training.mapInArrow(work, ", ".join(["block int", *(f"{c} binary" for c in [*names, "times"])]))
    return _written(packed.groupBy("block").applyInArrow(counted, "key long, context long, shorter long, n long"))


def _level(found: DataFrame, shorter: DataFrame, tokens: int, context_seen: int) -> tuple[DataFrame, DataFrame]:
    """(strings, states) of one depth.

    ``shorter`` and the strings have key, n and ``chance``: log10 of the chance of
    the last word after the longest state among the words before it.  A context
    becomes a state if its successors diverge from what the next shorter state
    says by more than storing them costs: times seen times relative entropy
    against half a logarithm of the corpus for each.  ``extra`` is what a
    stored successor adds to its chance without it, and what a state adds to
    every successor.
    """
    contexts = shorter.where(F.col("n") >= context_seen).select(F.col("key").alias("context"), F.col("n").alias("total"))
    below = shorter.select(F.col("key").alias("shorter"), F.col("chance").alias("below"))
    tested = _written(found.join(contexts, "context").join(below, "shorter").select("key", "context", "n", "total", "below"))
    share, chance = F.col("n") / F.col("total"), F.pow(F.lit(10.0), "below")
    _removed(found)
    sums = tested.groupBy("context").agg(
        F.first("total").alias("total"), F.count(F.lit(1)).alias("stored"), F.sum(F.col("n") * F.log(share / chance)).alias("gain"),
        F.sum("n").alias("seen"), F.sum(chance).alias("mass"))
    left = (F.col("total") - F.col("seen")) / F.col("total")
    left_below = F.greatest(1 - F.col("mass"), F.lit(1e-12))
    gain = F.col("gain") + F.when(left > 0, F.col("total") * left * F.log(left / left_below)).otherwise(0.0)
    rest = (F.col("total") - F.col("seen") + DISCOUNT * F.col("stored")) / F.col("total")
    states = _written(sums.where(gain > 0.5 * F.col("stored") * math.log(max(tokens, 2))).select(
        "context", F.log10(rest / left_below).alias("weight"), F.col("total").alias("n")))
    own = F.log10((F.col("n") - DISCOUNT) / F.col("total"))
    strings = _written(tested.join(states.select("context", "weight"), "context", "left").select(
        "key", "n", F.when(F.col("weight").isNotNull(), own).otherwise(F.col("below")).alias("chance"),
        (own - F.col("below") - F.col("weight")).alias("extra")))
    _removed(tested)
    return strings, states.select(F.col("context").alias("key"), "n", F.col("weight").alias("extra"))


def learn(training: DataFrame, words: DataFrame, tokens: int, distinct: int, depth: int = DEPTH,
          context_seen: int = CONTEXT_SEEN) -> DataFrame:
    """key, n, known, base, extra of every string that says something; every level counts over all training texts.

    The log10 chance of a text is the sum of ``base`` and ``extra`` of all strings in
    it, less a logarithm of all words for each word: a state's ``extra`` comes with
    its words, as some successor always follows them.
    """
    shorter = words.withColumn("chance", F.log10(F.col("n") + 1) - math.log10(tokens + distinct + 1))
    parts = []
    for level in range(1, depth + 1):
        strings, states = _level(_successors(training, shorter, level, tokens, context_seen), shorter, tokens, context_seen)
        parts += [strings.where(F.col("extra").isNotNull()).select("key", "n", "extra"), states]
        shorter = strings
    single = words.select("key", "n", F.lit(1).alias("known"), F.log10(F.col("n") + 1).alias("base"), F.lit(0.0).alias("extra"))
    longer = [p.select("key", "n", F.lit(0).alias("known"), F.lit(0.0).alias("base"), "extra") for p in parts]
    model = _written(reduce(DataFrame.unionByName, longer, single).groupBy("key").agg(
        F.max("n").alias("n"), F.max("known").alias("known"), F.sum("base").alias("base"), F.sum("extra").alias("extra")))
    for table in parts:
        _removed(table)
    return model


def scores(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text",
           depth: int = DEPTH, context_seen: int = CONTEXT_SEEN) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words and strings of up to ``depth`` + 1 words are counted over all texts that
    are not held out, and a suffix tree over them gives the chance of each word
    after the longest state that ends before it.  The tree is a table by
    string and meets the strings of the texts block by block of keys; frequent
    strings are looked up in the tasks, so no block is hot.  ``base_score`` is the
    same with single words and add-one smoothing.

    Null and empty texts are an end alone.  Without training texts nothing is
    known and all chances are even, so both scores are 0 per token.  Repeated
    rows and ids give a row each; other columns are not read.
    """
    training = docs.where(~held_out).select(whole_text(text_column).alias("text"))
    words = count_words(training)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    n, v = total["tokens"], total["distinct"]
    model = learn(training, words, n, v, depth if n else 0, context_seen)
    _removed(words)
    hot = F.col("n") >= max(HOT_SHARE * n, 1)
    table = model.where(hot).orderBy("key").toArrow()
    hot_keys = table.column("key").to_numpy()
    values = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("known", "base", "extra")])
    shared = docs.sparkSession.sparkContext.broadcast((hot_keys, values, _bit_map(model.where("known = 0"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                       held_out.alias("held_out"), whole_text(text_column).alias("text"))
    bits = _block_bits(n, ASKED_TOKENS)
    kind = docs.schema[id_column].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, values, longer = shared.value
        for batch in chunks(batches):
            hashes, place, text = _hashed(batch.column("text"))
            size, row = batch.num_rows, batch.column("row").to_numpy()
            sums, open_keys, open_texts = np.zeros((3, size)), [], []
            for length, keys in enumerate(_strings(hashes, depth + 1 if len(hot_keys) else 1), start=1):
                mine = place >= max(length - 1, 1)
                keys, owner = keys[mine], text[mine]
                if length > 1:
                    some = _mapped(longer, keys)
                    keys, owner = keys[some], owner[some]
                at = np.minimum(np.searchsorted(hot_keys, keys.view(np.int64)), max(len(hot_keys) - 1, 0))
                hit = hot_keys[at] == keys.view(np.int64) if len(hot_keys) else np.zeros(len(keys), bool)
                for k in range(3):
                    sums[k] += np.bincount(owner[hit], values[k][at[hit]], size)
                open_keys.append(keys[~hit])
                open_texts.append(owner[~hit])
            keys, owner = np.concatenate(open_keys), np.concatenate(open_texts).astype(np.int32)
            block = (keys >> np.uint64(64 - bits)).astype(np.int32)
            order = np.lexsort((owner, block))
            ends = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=1 << bits))])
            keys, owner = keys[order], owner[order]
            full = np.flatnonzero(np.diff(ends))
            own = int(_mixed(row[:1].astype(np.uint64))[0] % np.uint64(1 << bits))  # where the chunk's own sums travel
            tokens = np.bincount(text[place > 0], minlength=size).astype(np.float64)

            def numbered(owners: np.ndarray) -> bytes:
                """The first row of the chunk, and how far after it each owner is."""
                return row[:1].tobytes() + (row[owners] - row[0]).astype(np.int32).tobytes()

            def lists(column: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array([0] * (len(full) + 1) + [size], pa.int32()), column)

            yield pa.RecordBatch.from_arrays(
                [pa.array([*full.tolist(), own], pa.int32()),
                 pa.array([numbered(owner[ends[i]:ends[i + 1]]) for i in full] + [numbered(np.arange(size))], pa.binary()),
                 pa.array([keys[ends[i]:ends[i + 1]].tobytes() for i in full] + [None], pa.binary()), lists(batch.column("id")),
                 lists(batch.column("held_out")), pa.array([None] * len(full) + [np.concatenate([tokens, *sums]).tobytes()], pa.binary())],
                names=["block", "rows", "keys", "ids", "held", "sums"])

    def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
        stored = known.column("key").to_numpy().astype(np.int64)
        order = np.argsort(stored)
        stored, said = stored[order], [known.column(c).to_numpy().astype(np.float64)[order] for c in ("known", "base", "extra")]
        parts = []
        for record in asked.select(["rows", "keys", "sums", "ids", "held"]).to_batches(max_chunksize=1):
            row_bytes, key_bytes, sum_bytes = (record.column(i)[0].as_py() for i in range(3))
            row = np.frombuffer(row_bytes, np.int64, 1) + np.frombuffer(row_bytes, np.int32, offset=8)
            if key_bytes is None:
                sums, ids, held = np.frombuffer(sum_bytes).reshape(4, -1), record.column(3)[0].values, record.column(4)[0].values
            else:
                keys = np.frombuffer(key_bytes, np.int64)
                at = np.searchsorted(stored, keys)
                hit = np.flatnonzero(stored[np.minimum(at, len(stored) - 1)] == keys) if len(stored) else np.zeros(0, np.int64)
                at = at[hit]
                row, owner = np.unique(row[hit], return_inverse=True)
                sums = np.stack([np.zeros(len(row)), *(np.bincount(owner, x[at], len(row)) for x in said)])
                ids, held = pa.nulls(len(row), record.schema.field(3).type.value_type), pa.nulls(len(row), pa.bool_())
            parts.append(pa.table([pa.array(row), ids, held, *map(pa.array, sums)], schema=pa.schema(
                [("row", pa.int64()), ("id", ids.type), ("held_out", pa.bool_()), *((c, pa.float64()) for c in ("n_tokens", "known", "base", "extra"))])))
        if not parts:  # a block that no text asks
            return pa.table({"row": pa.array([], pa.int64()), "id": pa.nulls(0, asked.schema.field("ids").type.value_type),
                             "held_out": pa.nulls(0, pa.bool_()), **{c: pa.array([], pa.float64()) for c in ("n_tokens", "known", "base", "extra")}})
        return pa.concat_tables(parts)

    asked = rows.mapInArrow(work, StructType([
        StructField("block", IntegerType()), StructField("rows", BinaryType()), StructField("keys", BinaryType()),
        StructField("ids", ArrayType(kind)), StructField("held", ArrayType(BooleanType())), StructField("sums", BinaryType())]))
    rest = model.where(~hot).select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("block"), "key", "known", "base", "extra")
    numbers = [StructField(c, DoubleType()) for c in ("n_tokens", "known", "base", "extra")]
    parts = asked.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(
        answered, StructType([StructField("row", LongType()), StructField("id", kind), StructField("held_out", BooleanType()), *numbers]))
    full = parts.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), F.first("held_out", ignorenulls=True).alias("held_out"),
                                    *[F.sum(f.name).alias(f.name) for f in numbers])
    base = F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)
    return full.select("id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"),
                       F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("extra")).alias("score"))
