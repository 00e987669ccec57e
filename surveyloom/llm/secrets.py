"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import whole_text
from surveyloom.sources.scratch import settle

# The base kinds in their order, with the pattern of each and the least length of its secret part.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {"assign": (ASSIGN, 1, 12), "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]+", 0, 16)}
ADDED = "markov"
# Fixed value: characters of identifiers and secrets.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
# Fixed value: those of one class take part in the same alphabets of keys.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_.=-")
# No run of fewer characters can be told from a rare word: each pair tells little.  Nor can a plain word
# of up to PLAIN letters, a capital before and a mark behind it included; longer runs of letters are scored.
SHORTEST, PLAIN = 8, 14
# Share of an even spread in the two models: a random string may go on with any class
# of characters, also where no sample shows it; an ordinary one hardly ever does.
RANDOM_EVEN, ORDINARY_EVEN = 0.5, 0.01
# Log-odds against a run being a secret before its characters are seen (about 1 in 160,000).
PRIOR = 12.0
# How often the models are learned again, likely keys having moved to the random side.
ROUNDS = 2
# Of a character seen so many times, what follows weighs as much as what is frequent anywhere.
TRUSTED = 5.0

SPAN = "struct<kind:string,rank:int,start:int,end:int,value:string>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters, in code points.

    The text between matches and the matches give the places: each match starts
    after all that comes before it.
    """
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    matches = F.zip_with(whole, secret, lambda m, s: F.struct(F.length(m).alias("size"), s.alias("value")))
    steps = F.zip_with(between, matches, lambda gap, m: F.struct(
        gap.alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(done: Column, s: Column) -> Column:
        first = done["at"] + s["gap"]
        last = first + F.coalesce(s["size"], F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), first.alias("start"),
                        last.alias("end"), s["value"].alias("value"))
        return F.struct(last.alias("at"), F.when(F.length(s["value"]) >= least, F.concat(done["spans"], F.array(span)))
                        .otherwise(done["spans"]).alias("spans"))

    found = F.aggregate(steps, start, step)["spans"]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _base_spans(text: Column) -> Column:
    kinds = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        # Where the pattern is one run of characters, shorter runs need not be looked at.
        tight = pattern.removesuffix("+") + f"{{{least - len('AKIA') * (kind == 'access')},}}" if group == 0 else pattern
        kinds.append(_spans(text, kind, rank, tight, group, least))
    return F.concat(*kinds)


def candidate_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, base (spans of the base kinds) and runs (runs of identifier characters that no base span covers whole) of each row."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    end = "(?![A-Za-z0-9+/_.=-])"
    run = (f"(?<![A-Za-z0-9+/_.=-])(?![A-Z]?[a-z]{{0,{PLAIN}}}[+/_.=-]?{end}|[A-Z]{{0,{PLAIN}}}[+/_.=-]?{end})"
           f"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
    found = rows.select("id", _base_spans(F.col("text")).alias("base"),
                        _spans(F.col("text"), ADDED, len(BASE), run, 0, SHORTEST).alias("runs"))
    open_ = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return found.select("id", "base", open_.alias("runs"))


def labelled_samples(found: DataFrame) -> DataFrame:
    """(value, secret, n): what the base patterns caught, and the runs that touch none of it and occur again.

    Ordinary identifiers recur, keys hardly do: a run counts as often as it is
    repeated, so one that occurs once counts with 0.
    """
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    each = found.select(F.explode(F.concat(
        F.transform("base", lambda b: F.struct(b["value"].alias("value"), F.lit(True).alias("secret"))),
        F.transform(free, lambda r: F.struct(r["value"].alias("value"), F.lit(False).alias("secret"))))).alias("s"))
    return each.groupBy("s.value", "s.secret").agg((F.count(F.lit(1)) - F.when(F.col("secret"), 0).otherwise(1)).alias("n"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each character after each other.

    Pairs of adjacent characters are counted over all samples by Spark; at most
    one count per pair and label comes to the driver.  A random string goes from
    class to class of characters as the secrets do, and takes any character of a
    class alike; ordinary strings go from character to character, where rare ones
    lend what is frequent anywhere.  Without samples of a label its model is an even spread.
    """
    pairs = samples.select("secret", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))),
        lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    counts = {True: {}, False: {}}
    for r in pairs.groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["secret"]][r["pair"]] = r["n"]
    kind, size = {c: k for k, chars in enumerate(CLASSES) for c in chars}, len(ALPHABET)
    moves = [[0] * len(CLASSES) for _ in CLASSES]
    for pair, n in counts[True].items():
        if len(pair) == 2:
            moves[kind[pair[0]]][kind[pair[1]]] += n

    def random_chance(a: str, b: str) -> float:
        row, to = moves[kind[a]], len(CLASSES[kind[b]])
        seen = row[kind[b]] / sum(row) if sum(row) else to / size
        return ((1 - RANDOM_EVEN) * seen + RANDOM_EVEN * to / size) / to

    each = {b: sum(counts[False].get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
    pairs_seen = sum(each.values())

    def ordinary_chance(b: str, n: int, total: int) -> float:
        if not pairs_seen:
            return 1 / size
        follows = (n + TRUSTED * each[b] / pairs_seen) / (total + TRUSTED)
        return (1 - ORDINARY_EVEN) * follows + ORDINARY_EVEN / size

    ratios = []
    for a in ALPHABET:
        row = [counts[False].get(a + b, 0) for b in ALPHABET]
        ratios += [math.log(random_chance(a, b)) - math.log(ordinary_chance(b, n, sum(row))) for b, n in zip(ALPHABET, row)]
    return ratios


def learn(found: DataFrame, prior: float = PRIOR, rounds: int = ROUNDS) -> list[float]:
    """A model of the labelled samples; runs that it takes for keys count as secrets when it is learned again."""
    samples = settle(labelled_samples(found))
    model = train(samples)
    for _ in range(rounds):
        key = F.col("secret") | ((F.length("value") >= SHORTEST) & (ratio(F.col("value"), model) > prior))
        model = train(samples.withColumns({"secret": key, "n": F.greatest("n", key.cast("long"))}))
    return model


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of the alphabet's characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    size = len(ALPHABET)

    # Each character's number once, then the sum over the pairs.
    numbers = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))

    def step(done: Column, number: Column) -> Column:
        more = F.when(done["before"] == 0, 0.0).otherwise(F.element_at(table, F.greatest((done["before"] - 1) * size + number, F.lit(1))))
        return F.struct(number.alias("before"), (done["total"] + more).alias("total"))

    return F.aggregate(numbers, start, step)["total"]


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 prior: float = PRIOR) -> DataFrame:
    """id and spans (kind, rank, start, end, value) of each row, by start and then kind.

    The base kinds are leftmost non-overlapping matches of fixed patterns.  Other
    runs of identifier characters are added as ``markov`` where a Markov model of
    random strings explains them better than one of ordinary identifiers, by more
    than the ``prior`` log-odds.  Both models learn from the whole table: the
    values caught by the base patterns are samples of secrets, the runs that
    touch none are samples of ordinary identifiers unless the model itself takes
    them for keys.  Runs that a base span covers only in part are scored too; runs
    under ``SHORTEST`` characters and plain words of up to ``PLAIN`` letters are not.

    Null and empty texts have no spans; repeated rows and ids give a row each;
    an empty table gives an empty one.  Other columns are not read.
    """
    found = candidate_spans(docs, id_column, text_column)
    model = learn(found, prior)
    added = F.filter("runs", lambda r: ratio(r["value"], model) > prior)
    return found.select("id", F.array_sort(
        F.concat("base", added),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"])
    ).alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
