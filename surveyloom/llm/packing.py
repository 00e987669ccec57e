"""Packing of tokenised documents into fixed windows with minimum bin slack."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.arrowtext import chunks, coded, words_of
from surveyloom.llm.common import whole_text
from surveyloom.sources.scratch import settle

CAPACITY = 4096
END_ID = 2
# Distinct words a worker remembers with their ids, some 100 MB.
REMEMBERED_WORDS = 300_000
# Words given to the tokenizer at once.
AT_ONCE = 512

# What the vocabulary's pre-tokenizer takes as one piece, and the mark of a piece's last token.
PIECE = "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"
PIECE_END = "</w>"
# Words of these characters are in normal form and have one lower-case letter for each capital.
PLAIN = "^[\\x21-\\x7E\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{FF}]+$"


class WordIds:
    """Token ids of words, each distinct word tokenised once.

    White space ends a token in this vocabulary and is dropped, so the ids of a
    text are those of its words in turn.  Words are tokenised many at a time;
    the ids are dealt back to words by counting pieces, whose last tokens are
    marked.  Words whose pieces cannot be counted plainly are tokenised alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(PIECE_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: pa.Array) -> None:
        spelled = words.to_pylist()
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        pieces = pc.count_substring_regex(words, PIECE).to_numpy(zero_copy_only=False)
        together = plain & ~special
        found: list[list[int] | np.ndarray | None] = [None] * len(spelled)
        for at in np.flatnonzero(~together):
            found[at] = self.encode(spelled[at])
        some = np.flatnonzero(together)
        for first in range(0, len(some), AT_ONCE):
            group = some[first:first + AT_ONCE]
            ids = np.array(self.encode(" ".join([spelled[i] for i in group])), dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum(pieces[group])
            if len(ends) != last[-1]:
                for at in group:
                    found[at] = self.encode(spelled[at])
            else:
                for at, part in zip(group, np.split(ids, ends[last[:-1] - 1]), strict=True):
                    found[at] = part
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        base = len(self.place)
        self.place.update(zip(spelled, range(base, base + len(spelled)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *[np.asarray(f, dtype=np.uint32) for f in found]])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the place where each text's ids end."""
        words, ends = words_of(texts)
        codes, distinct = coded(words)
        known = [self.place.get(w, -1) for w in distinct.to_pylist()]
        place = np.array(known, dtype=np.int64)
        if (place < 0).any():
            if len(self.place) > REMEMBERED_WORDS:
                self.forget()
                place[:] = -1
            new = np.flatnonzero(place < 0)
            place[new] = len(self.place) + np.arange(len(new))
            self._learn(distinct.take(pa.array(new)))
        at = place[codes]
        sizes, starts = self.sizes[at], self.starts[at]
        run = np.cumsum(sizes)
        ids = self.ids[np.repeat(starts - (run - sizes), sizes) + np.arange(run[-1] if len(run) else 0)]
        return ids, np.concatenate([[0], run])[ends]


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer; kept between tasks."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


PIECES = "row long, id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
        capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: row, id, start, length, ids_crc32, doc_tokens.

    A document is its ids and the end id; one of more than ``capacity`` ids is
    cut into full windows and a rest.  Null text counts as empty and gives a
    piece of the end id alone.
    """
    id_type = docs.schema[id_column].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                       whole_text(text_column).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path)
        for batch in chunks(batches):
            ids, ends = known.texts(batch.column("text"))
            ids = ids.astype("<u4")
            end = np.array([end_id], dtype="<u4").tobytes()
            out: list[tuple[int, int, int, int, int]] = []
            for doc, (first, last) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                raw = ids[first:last].tobytes() + end
                total = len(raw) // 4
                for start in range(0, total, capacity):
                    part = raw[4 * start:4 * (start + capacity)]
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            doc, start, length, crc, total = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc)), batch.column("id").take(pa.array(doc)),
                 *map(pa.array, (start, length, crc, total))],
                names=["row", "id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(tokenise, PIECES.format(id_type=id_type.simpleString()))


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) for windows that use up all lengths.

    Each window takes the longest length left and the multiset of the others
    that fills it closest to capacity.  Reachable totals are bits of one integer
    per length; the chosen total is traced back through them.  A multiset is
    used as often as the counts allow, so the work depends on the number of
    lengths, at most ``capacity``, and not on the number of documents.
    """
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    windows: list[tuple[int, dict[int, int]]] = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        mask, goal = (1 << (room + 1)) - 1, 1 << room
        reach, steps = 1, []
        for length, count in left.items():
            most = min(count - (length == longest), room // length)
            if most <= 0:
                continue
            steps.append((length, reach))
            # Any number of copies up to ``most``, by doubling.
            copies = 1
            while most > 0:
                copies = min(copies, most)
                reach |= (reach << (length * copies)) & mask
                most -= copies
                copies *= 2
            if reach & goal:
                break
        total = reach.bit_length() - 1
        chosen = {longest: 1}
        for length, before in reversed(steps):
            used = 0
            while not before >> total & 1:
                total -= length
                used += 1
            if used:
                chosen[length] = chosen.get(length, 0) + used
        times = min(left[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        windows.append((times, chosen))
    return windows


def _slots(spark: SparkSession, windows: list[tuple[int, dict[int, int]]]) -> DataFrame:
    """Where the pieces of a length go: ranks ``first`` up to ``last`` of that length fill
    ``each`` places, from ``place`` on, of the windows numbered from ``window`` on."""
    rows, ranks, window = [], {}, 0
    for times, chosen in windows:
        place = 0
        for length, each in chosen.items():
            first = ranks.get(length, 0)
            ranks[length] = first + times * each
            rows.append((length, first, ranks[length], each, place, window))
            place += length * each
        window += times
    return spark.createDataFrame(rows, "length long, first long, last long, each long, place long, window long")


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are counted by length, the few counts are planned into windows on the
    driver, and every piece finds its place by its rank among the pieces of its
    length.  Ranks are counted per block of rows and then summed over blocks, so
    a length that a third of all pieces share is ranked by many tasks.

    Every id of every document lies in exactly one piece, and offsets in a
    sequence have no gaps.  Null and empty texts are one id long; null and
    repeated ids make no difference; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    pieces = settle(cut(docs, tokenizer_path, id_column, text_column, capacity, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(spark, plan_windows(counts, capacity))
    # As many blocks as rows in a block, should all pieces be of one length.
    blocks = math.isqrt(sum(counts.values())) + 1
    spread = pieces.withColumn("block", F.pmod(F.xxhash64("row", "start"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = spread.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("head"))
    inside = Window.partitionBy("length", "block").orderBy("row", "start")
    ranked = (spread.withColumn("rank", F.row_number().over(inside) - 1).join(heads, ["length", "block"])
              .withColumn("rank", F.col("rank") + F.col("head")))
    s = slots.alias("s")
    # The slots are bounded by the capacity: each multiset uses up a length.
    placed = ranked.alias("p").join(F.broadcast(s), (F.col("p.length") == F.col("s.length"))
                                    & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    ahead = F.col("rank") - F.col("first")
    return placed.select(
        "id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("window") + F.floor(ahead / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("place") + ahead % F.col("each") * F.col("p.length")).alias("offset"))
