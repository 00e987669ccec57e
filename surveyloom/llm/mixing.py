"""Mix documents so that the words of every source come near its share, by thresholds on a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyloom.llm.common import whole_text
from surveyloom.operators.joins import scalars
from surveyloom.operators.running import running_totals
from surveyloom.sources.scratch import settle

# Weights of the sources in the order of their names, from the start again after the last.
WEIGHTS = (5, 2, 1)
# Words of the mix per hundred words of all documents, and how often a document is taken at most.
SHARE, MOST = 150, 2
WORD = "[^\\x20\\x09-\\x0D]+"
# Bits of the hash that one histogram looks at, and that each of the two hashes has.
DIGIT, HASH = 10, 60


def _measured(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """id, source, size, first and second hash of each row, written once.

    The first hash comes from id and text, so it is the same in every run; rows that
    share it are copies of each other, told apart by a number of the written table
    in the second.  Any of such copies may be the one that is taken.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), whole_text(text_column)))
    rows = settle(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        F.regexp_count(whole_text(text_column), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(key, 1, HASH // 4), 16, 10).cast("long").alias("first"),
        F.monotonically_increasing_id().alias("row")))
    return rows.select("id", "source", "size", "first", F.shiftrightunsigned(F.xxhash64("row"), 64 - HASH).alias("second"))


def _level(sources: DataFrame, weights: Sequence[int], share: int, most: int) -> DataFrame:
    """Add the target of every source (source, source_size).

    A source may hold ``most`` times its words.  Once those of the lowest bound
    per weight are full, the rest is shared by weight; of all levels that this
    gives, the highest is the one at which no target is above its bound.
    """
    named = running_totals(sources.where("source is not null").withColumn("one", F.lit(1)), [], "source", ["one"])
    numbered = named.select("source", "source_size", F.col("one_run").alias("place"))
    last = scalars(numbered.agg((F.coalesce(F.max("place"), F.lit(0)) + 1).alias("place")))
    nameless = sources.where("source is null").withColumn("place", last["place"])
    cycle = F.array(*map(F.lit, weights))
    weighed = settle(numbered.unionByName(nameless).withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))))

    bound = most * F.col("source_size")
    steps = weighed.groupBy((bound / F.col("weight")).alias("fullness")).agg(
        F.sum(bound).alias("bound"), F.sum("weight").cast("long").alias("weight"))
    ordered = running_totals(steps, [], "fullness", ["bound", "weight"])
    # Where every step up to the one before is full; all amounts a hundredfold, so that they stay whole numbers.
    full, open_weight = F.col("bound_run") - F.col("bound"), F.col("weight_all") - F.col("weight_run") + F.col("weight")
    budget = F.col("bound_all") / most * share
    level = scalars(ordered.agg(F.max((budget - 100 * full) / (100 * open_weight)).alias("level")))
    return weighed.select("source", "source_size",
                          F.least(bound.cast("double"), F.col("weight") * level["level"]).alias("target"))


def _digit(key: str, step: int) -> Column:
    return F.shiftrightunsigned(key, HASH - DIGIT * (step + 1)).bitwiseAND((1 << DIGIT) - 1)


def _thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, first, second): rows of a source up to that pair of hashes make up the words ``open`` of ``wanted``.

    Words are summed by source and the leading digit of the hash.  The bucket in
    which the sum passes what is wanted is looked at again, by the next digit, and
    so on until it holds one row.  Each histogram has 1,024 buckets a source at
    most, and each reads only the rows of the bucket before it.
    """
    source = F.col("source")
    live = settle(rows.join(wanted.where("open > 0").withColumnRenamed("source", "_s"), source.eqNullSafe(F.col("_s")))
                  .drop("_s", "id"))
    done, key, step = None, "first", 0
    while True:
        buckets = live.groupBy("source", "open", _digit(key, step).alias("digit")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.max("first").alias("high"),
            F.min("first").alias("low"), F.max("second").alias("second"))
        along = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = buckets.withColumn("run", F.sum("words").over(along))
        # The first bucket that does not fit whole; the one before it is the last that does.
        edge = settle(passed.where("run > open").groupBy("source").agg(
            F.min_by(F.struct("digit", "n", "low", "high", "second", "words", (F.col("open") - F.col("run") + F.col("words")).alias("rest")), "digit")
            .alias("at")).select("source", "at.*"))
        # One row left: it is taken if that comes nearer than leaving it.
        single = edge.where("n = 1").select(
            "source", F.col("high").alias("first"),
            (F.col("second") - F.when(2 * F.col("rest") >= F.col("words"), 0).otherwise(1)).alias("second"))
        done = single if done is None else done.unionByName(single)
        several = edge.where("n > 1").select(F.col("source").alias("_s"), F.col("digit").alias("_d"), F.col("rest"), "low", "high")
        facts = several.agg(F.count(F.lit(1)).alias("n"), F.max((F.col("low") < F.col("high")).cast("int")).alias("differ")).first()
        last = step + 1 == HASH // DIGIT
        if not facts.n or (key == "second" and last):
            # Copies whose numbers share a hash as well stay together.
            return settle(done.unionByName(several.select(F.col("_s").alias("source"), F.col("low").alias("first"), F.lit(-1).cast("long").alias("second"))))
        live = settle(live.join(several, source.eqNullSafe(F.col("_s")) & (_digit(key, step) == F.col("_d")))
                      .select("source", F.col("rest").alias("open"), "size", "first", "second"))
        # Copies only: their first hash has nothing more to tell.
        key, step = ("second", 0) if key == "first" and (last or not facts.differ) else (key, step + 1)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken.

    ``size`` is the number of words, ``source_size`` that of all documents of the
    source.  Sources, in order of their names by code point, weigh ``weights`` over
    and over, one without a name last; the mix has ``share`` hundredths of all
    words, dealt by weight, but no source gets more than ``most`` times its words
    and what is left over goes to the others by weight.  ``taken`` says how many
    words of the document the mix has: every document as often as the target
    covers its source whole, and once more if its hash is under the threshold of
    the source, which comes as near to the target as whole documents allow.

    A smaller mix of the same documents is part of a larger one.  Texts that are
    empty or null have no words and are taken with 0.  Repeated rows count each.
    No documents give no rows.  Other columns are not read.
    """
    if share > 100 * most:
        raise ValueError(f"a mix of {share} hundredths needs more than {most} of each document")
    rows = _measured(docs, id_column, text_column, source_column)
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = _level(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = settle(targets.withColumn("whole", whole).withColumn("open", F.col("target") - F.col("whole") * F.col("source_size")))
    cut = _thresholds(rows, wanted.select("source", "open"))
    named = cut.select(F.col("source").alias("_c"), F.col("first").alias("cut"), F.col("second").alias("cut_second"))
    plan = settle(wanted.join(named, F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c"))
    under = (F.col("first") < F.col("cut")) | ((F.col("first") == F.col("cut")) & (F.col("second") <= F.col("cut_second")))
    times = F.col("whole") + F.coalesce(under, F.lit(False)).cast("long")
    return rows.join(plan.withColumnRenamed("source", "_p"), F.col("source").eqNullSafe(F.col("_p"))).select(
        "id", "size", "source_size", "target", (times * F.col("size")).alias("taken"))
