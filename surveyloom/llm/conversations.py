"""Repair of conversations whose rows are blank, repeated, cut off or out of turn."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm import crossing
from surveyloom.sources.scratch import settle

# A row without a character outside these is blank; a row is cut off unless the last such one ends a sentence.
WORDED = "[^\\x20\\x09-\\x0D]"
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"
# Pairs of role initials that may follow each other.
LEGAL = ("su", "ua", "au")
# Most rows of one piece, and least for which another task is worth while.
PIECE_ROWS, LEAST_ROWS = 200_000, 1_000
# Pieces whose solution a worker remembers: short conversations repeat.
REMEMBERED = 100_000
ORDER = ["known", "turn", "role", "mark"]


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, known (the turn is not missing), turn, role, mark (a fingerprint of the text), text."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"),
        filled(role).alias("role"), F.unhex(F.md5(filled(text))).alias("mark"), filled(text).alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: n copies, blank, repeated (an earlier row says the same), cut, initial."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    light = settle(rows.groupBy(
        "conv", *ORDER, initial.alias("initial"), (~F.col("text").rlike(WORDED)).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("cut")).agg(F.count(F.lit(1)).alias("n")))
    again = settle(light.groupBy("conv", "role", "mark").agg(
        F.min(F.struct("known", "turn")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1"))
    l, a = light.alias("l"), again.alias("a")
    same = F.col("l.conv").eqNullSafe(F.col("a.conv")) & (F.col("l.role") == F.col("a.role")) & (F.col("l.mark") == F.col("a.mark"))
    later = F.coalesce(F.struct("l.known", "l.turn") > F.col("a.first"), F.lit(False))
    return settle(l.join(a, same, "left").select("l.*", (later & ~F.col("blank")).alias("repeated")))


def _letters() -> Column:
    """A row and its copies in the text form of ``crossing``; all but the first copy must go."""
    gone = F.concat(F.lit("#"), "initial")
    kept = F.when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    copies = F.when(F.col("n") > 1, F.concat(gone, (F.col("n") - 1).cast("string"))).otherwise("")
    return F.when(F.col("blank") | F.col("repeated"), F.concat(gone, F.col("n").cast("string"))).otherwise(F.concat(kept, copies))


def _clashes(rows: list[crossing.Run]) -> int:
    initials = [letter[-1].lower() for letter, _ in rows]
    return sum(n - 1 for _, n in rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _pieces(marked: DataFrame) -> DataFrame:
    """Conversations in order of their rows, cut where a block of rows ends.

    conv, block, letters, the order columns of the first row, clashes inside, first
    and last initial, and for those that may go on in another block the costs
    from every state to every state.
    """
    rows = marked.count()
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(rows / PIECE_ROWS), min(parts, math.ceil(rows / LEAST_ROWS)), 1)
    order = ["conv", *ORDER]
    placed = (marked.select(*order, _letters().alias("letters")).repartitionByRange(blocks, *order)
              .sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REMEMBERED)
        def facts(letters: str) -> tuple[int, str, str]:
            runs = crossing.runs(letters)
            return _clashes(runs), runs[0][0][-1].lower(), runs[-1][0][-1].lower()

        def piece(head: dict, letters: list[str], outer: bool) -> dict:
            whole = "".join(letters)
            clashes, first, last = facts(whole)
            return {**head, "letters": whole, "clashes": clashes, "first": first, "last": last,
                    "costs": crossing.transfer(crossing.runs(whole)) if outer else None}

        head, letters, outer = None, [], True
        for batch in batches:
            found = []
            names = [n for n in batch.schema.names if n != "letters"]
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for i, (conv, letter) in enumerate(zip(columns["conv"], columns["letters"])):
                if head is None or conv != head["conv"]:
                    if head is not None:
                        found.append(piece(head, letters, outer))
                        outer = False
                    head, letters = {name: columns[name][i] for name in names}, []
                letters.append(letter)
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=shape)
        if head is not None:  # the last may go on in the next block
            yield pa.RecordBatch.from_pylist([piece(head, letters, True)], schema=shape)

    kind = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join([*(f"{n} {kind[n]}" for n in ["conv", "block", *ORDER]), "letters string, clashes long, first string, "
                        "last string, costs array<double>"])
    shape = placed.sparkSession.createDataFrame([], schema).toArrow().schema
    return settle(placed.mapInArrow(work, schema))


def _solved(pieces: DataFrame) -> DataFrame:
    """The pieces with their audit, its cost, the state before, and the number of rows said before."""
    several = Window.partitionBy("conv")
    outer = settle(pieces.where("costs is not null").select(
        "conv", "block", "costs", F.count(F.lit(1)).over(several).alias("n")).where("n > 1").drop("n"))

    @F.udf("array<struct<before: int, after: int>>")
    def states(costs):
        return crossing.states_between(costs)

    chains = outer.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("p")).select(
        "conv", F.col("p.block").alias("blocks"), states("p.costs").alias("states"))
    known = settle(chains.select("conv", F.inline(F.arrays_zip("blocks", "states"))).select(
        F.col("conv").alias("_conv"), F.col("blocks").alias("_block"), "states.before", "states.after",
        (F.max("blocks").over(Window.partitionBy("conv")) == F.col("blocks")).alias("ends")))
    joined = pieces.drop("costs").join(
        known, (F.col("block") == F.col("_block")) & F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv", "_block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(REMEMBERED)
        def solve(letters: str, before: int | None, after: int | None, ends: bool | None) -> tuple[str, int, int]:
            runs = crossing.runs(letters)
            start = crossing.START if before is None else before
            end = crossing.last_state(crossing.forward(runs, start)) if after is None else after
            inserts = crossing.END_INSERTS[end] if ends is not False else 0
            cost = crossing.cost_of(runs, start, end) + crossing.INSERT * inserts
            return crossing.audit_between(runs, start, end) + "I" * inserts, int(cost), start

        for batch in batches:
            asked = zip(*(batch.column(n).to_pylist() for n in ("letters", "before", "after", "ends")))
            audits, costs, starts = zip(*(solve(*piece) for piece in asked)) if batch.num_rows else ((), (), ())
            kept = [n for n in batch.schema.names if n not in ("letters", "before", "after", "ends")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(audits, pa.string()), pa.array(costs, pa.int64()),
                 pa.array(starts, pa.int32())], names=[*kept, "audit", "cost", "state"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields
            if f.name not in ("letters", "before", "after", "ends")]
    solved = joined.mapInArrow(work, ", ".join([*kept, "audit string, cost long, state int"]))
    along = Window.partitionBy("conv").orderBy("block")
    said = F.length(F.regexp_replace("audit", "D", "")).cast("long")
    return settle(solved.withColumn("said", said).withColumns({
        "offset": F.coalesce(F.sum("said").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "joint": F.lag("last").over(along), "part": F.row_number().over(along) - 1}))


Said = tuple[object, int, str, str, str]


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[Said | None]:
    """(conv, position, role, text, edit) of the repaired rows, from sorted rows each piece of which follows its audit.

    Holds one row at a time; None where a batch ends.
    """
    audit, at, state, place, conv = "", 0, crossing.START, 0, None

    def insert():
        nonlocal at, state, place
        speaker = crossing.NEEDED[state]
        said = (conv, place, "user" if speaker == "u" else "assistant", "", "I")
        at, state, place = at + 1, crossing.AFTER[speaker], place + 1
        return said

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "role", "text", "audit", "state", "offset")]
        for this, role, text, new, new_state, offset in zip(*columns):
            if new is not None:
                while at < len(audit):  # inserts at the end of the piece before
                    yield insert()
                audit, at, state, place, conv = new, 0, new_state, offset, this
                continue
            while audit[at] == "I":
                yield insert()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            speaker = "s" if edit == "K" and role[:1] == "s" else crossing.NEEDED[state]
            said = role if edit == "K" else "user" if speaker == "u" else "assistant"
            yield conv, place, said, text, edit
            state, place = crossing.SYSTEM if speaker == "s" else crossing.AFTER[speaker], place + 1
        yield None
    while at < len(audit):
        yield insert()


def _followed(rows: DataFrame, solved: DataFrame, deal: list[str]) -> DataFrame:
    """Rows and, before each piece, its audit, dealt by ``deal`` and in order."""
    headed = solved.select("conv", *ORDER, "part", "audit", "state", "offset", F.lit(0).alias("is_row"))
    stacked = rows.withColumn("is_row", F.lit(1)).unionByName(headed, allowMissingColumns=True)
    return stacked.repartition(*deal).sortWithinPartitions("conv", *ORDER, "is_row").select(
        "conv", "role", "text", "audit", "state", "offset")


class Repair:
    """The cheapest repair of every conversation of a table.

    A conversation is read by turn, missing turns first; rows of one turn by role
    and then by a fingerprint of the text.  Missing roles and texts count as one
    space; a missing conversation id is an id of its own.  A row may be kept (free),
    given the role user or assistant (3) or deleted (4), and empty rows of
    either role inserted (3); rows that are blank or say what an earlier row of the
    conversation said must go, and a row cut off within a sentence costs 3 if it stays.
    What remains reads system, if at all, once and first, then user and assistant
    in turn (going by the first letter of the role; others, and empty roles, cannot be
    kept), the assistant last; or it is empty.  Of the cheapest repairs the one is
    taken whose edits, as D, I, K and R in order, come first by ASCII.

    Very long conversations are cut into pieces of at most some ``PIECE_ROWS``
    different rows, which are solved apart once the states between them are known.
    Other columns are not read.
    """

    def __init__(self, conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
                 role_column: str = "role", text_column: str = "text"):
        self.rows = _rows(conversations, conv_column, turn_column, role_column, text_column)
        self.marked = _marked(self.rows)
        self.solved = _solved(_pieces(self.marked))

    def summary(self) -> DataFrame:
        """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        n, gone = F.col("n"), F.col("blank") | F.col("repeated")
        turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counts = self.marked.groupBy(F.col("conv").alias("_conv")).agg(
            F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).when(F.col("repeated"), n).otherwise(n - 1)).alias("duplicate"),
            F.sum(F.when(gone | ~F.col("cut"), 0).otherwise(1)).cast("long").alias("truncated"))
        apart = F.coalesce((~F.concat("joint", "first").isin(*LEGAL)).cast("long"), F.lit(0))
        edits = self.solved.groupBy("conv").agg(
            F.sum(F.col("clashes") + apart).alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.sort_array(F.collect_list(F.struct("block", "audit"))).getField("audit"), "").alias("audit"))
        return counts.join(edits, F.col("conv").eqNullSafe(F.col("_conv"))).select(
            "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def repaired(self) -> DataFrame:
        """The repaired rows: conv, position (from 0), role, text, edit; the pieces of a conversation in several tasks."""
        heads = self.solved.where("part > 0").groupBy(F.col("conv").alias("_conv")).agg(
            F.collect_list(F.struct(*ORDER)).alias("heads"))
        reached = F.size(F.filter("heads", lambda h: h <= F.struct(*ORDER)))
        parted = self.rows.join(settle(heads), F.col("conv").eqNullSafe(F.col("_conv")), "left").withColumn(
            "part", F.when(F.col("heads").isNull(), 0).otherwise(reached)).drop("_conv", "heads")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[Said] = []
            for said in _spoken(batches):
                if said is not None:
                    waiting.append(said)
                elif waiting:
                    yield batch_of(waiting)
                    waiting = []
            if waiting:
                yield batch_of(waiting)

        kind = self.rows.schema["conv"].dataType.simpleString()
        schema = f"conv {kind}, position long, role string, text string, edit string"
        batch_of = _batches(self.rows.sparkSession.createDataFrame([], schema).toArrow().schema)
        return _followed(parted, self.solved, ["conv", "part"]).mapInArrow(work, schema)

    def digests(self) -> DataFrame:
        """conv and the SHA-256 of its repaired rows as ``role:text``, joined by newlines.

        A hash of one conversation is one chain, so its rows pass through one task,
        one after the other; none are held.
        """
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def counted() -> Iterator[pa.RecordBatch]:
                # Also conversations of which nothing remains have a digest.
                for batch in batches:
                    seen.extend(c for c, a in zip(batch.column("conv").to_pylist(), batch.column("audit").to_pylist()) if a is not None)
                    yield batch

            seen: list = []
            chains: dict = {}
            for said in _spoken(counted()):
                if said is not None:
                    conv, place, role, text, _ = said
                    chain = chains.setdefault(conv, hashlib.sha256())
                    chain.update((("\n" if place else "") + f"{role}:{text}").encode())
                    continue
                # The last conversation of a batch may go on; the others are complete.
                last = seen[-1] if seen else None
                ready = dict.fromkeys(c for c in seen if c != last or type(c) is not type(last))
                if ready:
                    yield batch_of([(c, (chains.pop(c, None) or hashlib.sha256()).hexdigest()) for c in ready])
                    seen[:] = [last]
            if seen:
                yield batch_of([(c, (chains.pop(c, None) or hashlib.sha256()).hexdigest()) for c in dict.fromkeys(seen)])

        kind = self.rows.schema["conv"].dataType.simpleString()
        schema = f"conv {kind}, sha256 string"
        batch_of = _batches(self.rows.sparkSession.createDataFrame([], schema).toArrow().schema)
        return _followed(self.rows.withColumn("part", F.lit(0)), self.solved, ["conv"]).mapInArrow(work, schema)


def _batches(shape: pa.Schema) -> Callable[[list[tuple]], pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), shape)], schema=shape)
    return batch_of


def damaged(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
            role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Rows with faults planted by a hash of conversation and turn, for trying out repairs.

    Of 20 remainders of the hash, 0 drops the row, 1 empties its text, 2 takes out the
    ends of its sentences, 3 repeats it and 4 gives it to the user.  Missing values
    count as one space.  Other columns are left out.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled(conv_column), F.lit(":"), filled(turn_column)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv_column), F.col(turn_column), F.when(fault == 4, "user").otherwise(filled(role_column)).alias(role_column),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(filled(text_column), "[.!?]", ""))
        .otherwise(filled(text_column)).alias(text_column), F.when(fault == 3, 2).otherwise(1).alias("_times"), fault.alias("_fault"))
    return rows.where("_fault <> 0").select(*rows.columns[:4], F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_")).drop("_")
