"""Toxicity of texts: a recurrent network over words and their characters scores all overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import gru
from surveyloom.llm.arrowtext import chunks, coded, words_of
from surveyloom.llm.common import whole_text

# Labelled texts, and their characters, that the network is trained on; chosen by a
# hash of the id where there are more.
FIT_TEXTS, FIT_CHARACTERS = 6_000, 12_000_000
WINDOW, STRIDE = 16, 8
WORDS, WORD_WIDTH = 1024, 8
GRAMS, GRAM_BITS, GRAM_WIDTH = (3, 4, 5), 14, 8
GRAM_BUCKETS = 1 << GRAM_BITS
HIDDEN, ATTENTION = 8, 8
EPOCHS, BATCH, RATE = 8, 256, 0.01
# Windows scored at once in a task.
AT_ONCE = 8192
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Network:
    known: dict[str, int]      # word -> row of ``word``; row 0 stands for all others
    word: np.ndarray
    gram: np.ndarray
    weights: gru.Weights


def _bare(words: pa.Array) -> pa.Array:
    """Words without punctuation around them."""
    return pc.utf8_trim(words, characters=_MARKS)


def _grams(words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3, 4 and 5 bytes: (bucket, word) of the runs of that length, between marks of a word's start and end."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "")
    raw = marked.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(offsets))
    found = []
    code = np.zeros(len(data), np.uint64)
    for length in range(1, max(GRAMS) + 1):
        if len(data) < length:
            break
        # Runs of one byte more, from those that do not reach over the end.
        code = code[:len(data) - length + 1] * np.uint64(257) + data[length - 1:]
        if length in GRAMS:
            whole = owner[:len(code)] == owner[length - 1:]
            spread = (code + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
            found.append(((spread >> np.uint64(64 - GRAM_BITS)).astype(np.int32)[whole], owner[:len(code)][whole]))
    return found


def _inputs(network: Network, words: pa.Array) -> np.ndarray:
    """Input of every distinct word: its own vector and the mean of its character runs'.  Row 0 is no word."""
    rows = np.array([network.known.get(w, 0) for w in words.to_pylist()], dtype=np.int64)
    out = np.zeros((len(words) + 1, WORD_WIDTH + GRAM_WIDTH), np.float32)
    out[1:, :WORD_WIDTH] = network.word[rows]
    count = np.zeros(len(words), np.int64)
    for bucket, owner in _grams(words):
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first] + 1, WORD_WIDTH:] += np.add.reduceat(network.gram[bucket], first, axis=0)
            count += np.bincount(owner, minlength=len(words))
    out[1:, WORD_WIDTH:] /= np.sqrt(np.maximum(count, 1))[:, None]
    return out


def _windows(ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of every text, as word numbers from 1, and the text of each.

    Windows start every ``STRIDE`` words until one reaches the end; a text has at
    least one, which is padded with 0.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    each = 1 + np.maximum(-(-(sizes - WINDOW) // STRIDE), 0)
    text = np.repeat(np.arange(len(ends)), each)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    place = first[:, None] + np.arange(WINDOW)
    inside = place < sizes[text][:, None]
    at = np.where(inside, place + starts[text][:, None], 0)
    padded = codes if len(codes) else np.zeros(1, np.int64)
    return np.where(inside, padded[at] + 1, 0).astype(np.int32), text


def _prepared(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words, the distinct words in lower case without marks, and the text ends."""
    words, ends = words_of(texts)
    codes, distinct = coded(words)
    again, bare = coded(_bare(distinct))
    return (again[codes] if len(codes) else codes), bare, ends


def score_texts(network: Network, texts: pa.Array) -> np.ndarray:
    """Each text's largest chance over its windows."""
    codes, distinct, ends = _prepared(texts)
    gates = gru.gate_inputs(network.weights, _inputs(network, distinct))
    windows, text = _windows(ends, codes)
    odds = np.concatenate([gru.log_odds(network.weights, gates, windows[i:i + AT_ONCE])
                           for i in range(0, len(windows), AT_ONCE)]) if len(windows) else np.zeros(0)
    best = np.full(len(ends), -np.inf)
    np.maximum.at(best, text, odds)
    return 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -30, 30)))


def _odds(bad: np.ndarray, all_: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of parts of texts by how many toxic and how many texts hold them, against the mean."""
    prior = float(np.clip(toxic.mean() if len(toxic) else 0.5, 1e-3, 1 - 1e-3))
    share = (bad + 2 * prior) / (all_ + 2)
    return np.log(share / (1 - share)) - np.log(prior / (1 - prior))


class Runs:
    """The character runs of distinct words, laid end to end."""

    def __init__(self, words: pa.Array):
        found = _grams(words)
        bucket = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int32)
        owner = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        self.bucket, self.count = bucket[order], np.bincount(owner, minlength=len(words))
        self.begin = np.cumsum(self.count) - self.count

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, place in ``words``) of all runs of the given words."""
        size = self.count[words]
        at = np.repeat(self.begin[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.bucket[at], np.repeat(np.arange(len(words)), size)


def _evidence(codes: np.ndarray, ends: np.ndarray, runs: Runs, words: int, toxic: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many toxic texts and how many texts hold each word, and each bucket of character runs."""
    word, word_bad = np.zeros(words), np.zeros(words)
    gram, gram_bad = np.zeros(GRAM_BUCKETS), np.zeros(GRAM_BUCKETS)
    starts = np.concatenate([[0], ends])[:len(ends)]
    for label, start, end in zip(toxic, starts, ends, strict=True):
        mine = np.unique(codes[start:end])
        buckets = np.unique(runs.of(mine)[0])
        word[mine] += 1
        gram[buckets] += 1
        if label:
            word_bad[mine] += 1
            gram_bad[buckets] += 1
    return word, word_bad, gram, gram_bad


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Network:
    """Train on whole labelled texts.

    Only texts are labelled, so in every epoch a text stands for itself by the
    window that looks most toxic so far - at first by the evidence of its words
    and character runs - and clean texts also by further windows.  Vectors of
    words and runs start from the same evidence.  One label alone gives a
    network that answers with the share of toxic texts.
    """
    rng = np.random.default_rng(seed)
    codes, distinct, ends = _prepared(texts)
    windows, text = _windows(ends, codes)
    runs = Runs(distinct)
    often, bad, gram_often, gram_bad = _evidence(codes, ends, runs, len(distinct), labels)
    word_odds, gram_odds = _odds(bad, often, labels), _odds(gram_bad, gram_often, labels)
    gram_odds[gram_bad < 3] = np.minimum(gram_odds[gram_bad < 3], 0)

    telling = np.argsort(-np.abs(word_odds) * np.log1p(bad + often), kind="stable")
    telling = telling[often[telling] >= 3][:WORDS]
    spelled = distinct.to_pylist()
    network = Network({spelled[i]: k + 1 for k, i in enumerate(telling)},
                      (rng.normal(size=(WORDS + 1, WORD_WIDTH)) * 0.05).astype(np.float32),
                      (rng.normal(size=(GRAM_BUCKETS, GRAM_WIDTH)) * 0.05).astype(np.float32),
                      gru.initial(WORD_WIDTH + GRAM_WIDTH, HIDDEN, ATTENTION, rng))
    network.word[0] = 0
    network.word[1:len(telling) + 1, 0] += word_odds[telling] / 2
    network.gram[:, 0] += gram_odds / 4
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    if not len(labels) or labels.min() == labels.max():
        network.weights["wo"][:] = 0
        network.weights["co"][:] = np.log(prior / (1 - prior))
        return network

    bucket, owner = runs.of(np.arange(len(distinct)))
    by_runs = np.bincount(owner, gram_odds[bucket], len(distinct)) / np.sqrt(np.maximum(runs.count, 1))
    first_look = np.append(0, np.maximum(word_odds, by_runs))
    look = first_look[windows].max(axis=1)
    rows = np.array([network.known.get(w, 0) for w in spelled])
    steps = gru.Steps(RATE)
    tables = {"word": network.word, "gram": network.gram}
    for epoch in range(EPOCHS):
        if epoch:
            gates = gru.gate_inputs(network.weights, _inputs(network, distinct))
            look = np.concatenate([gru.log_odds(network.weights, gates, windows[i:i + AT_ONCE])
                                   for i in range(0, len(windows), AT_ONCE)])
        order = np.lexsort((-look, text))
        lead = order[np.concatenate([[True], np.diff(text[order]) > 0])]
        clean = np.flatnonzero(labels[text] == 0)
        chosen = np.concatenate([lead, rng.choice(clean, min(len(clean), 3 * len(lead)), replace=False)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            part = windows[chosen[at:at + BATCH]]
            target = labels[text[chosen[at:at + BATCH]]].astype(np.float32)
            used, inverse = np.unique(part, return_inverse=True)
            inverse = inverse.reshape(part.shape)
            real = used[used > 0] - 1
            inputs = np.zeros((len(used), WORD_WIDTH + GRAM_WIDTH), np.float32)
            has = used > 0
            inputs[has, :WORD_WIDTH] = network.word[rows[real]]
            mine, owner = runs.of(real)
            line = np.flatnonzero(has)[owner]
            weight = (1 / np.sqrt(np.maximum(runs.count[real], 1)))[owner]
            for k in range(GRAM_WIDTH):
                inputs[:, WORD_WIDTH + k] = np.bincount(line, network.gram[mine, k] * weight, len(used))
            grad, d_inputs = gru.gradients(network.weights, inputs[inverse], part > 0, target)
            flat = d_inputs.reshape(-1, d_inputs.shape[2])
            d_used = np.stack([np.bincount(inverse.reshape(-1), flat[:, k], len(used)) for k in range(flat.shape[1])], 1)
            d_word, d_gram = np.zeros_like(network.word), np.zeros_like(network.gram)
            np.add.at(d_word, rows[real], d_used[has, :WORD_WIDTH])
            for k in range(GRAM_WIDTH):
                d_gram[:, k] = np.bincount(mine, d_used[line, WORD_WIDTH + k] * weight, GRAM_BUCKETS)
            d_word[0] = 0
            steps.take(network.weights, grad)
            for name, d in (("word", d_word), ("gram", d_gram)):
                tables[name] -= 0.3 * d.astype(np.float32)
    return network


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text",
        label_id: str = "doc_id", label: str = "toxic", fit_texts: int = FIT_TEXTS,
        fit_characters: int = FIT_CHARACTERS) -> Network:
    """Train on a bounded sample of the labelled texts for which ``usable`` holds of the label's id."""
    given = labels.where(usable & F.col(label).isNotNull() & F.col(label_id).isNotNull()).select(
        F.col(label_id).alias("_id"), F.col(label).cast("int").alias("_label")).dropDuplicates(["_id"])
    sizes = {r["_label"]: r["count"] for r in given.groupBy("_label").count().collect()}
    part = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    chosen = given
    # Half of the sample is toxic, as far as there are so many.
    for value, count in sizes.items():
        chosen = chosen.where((F.col("_label") != value) | (part < int(1_000_000 * min(1, fit_texts / 2 / count))))
    texts = docs.select(F.col(id_column).alias("_id"), whole_text(text_column).alias("_text"))
    # The sample has at most about ``fit_texts`` ids, whatever the tables hold.
    picked = texts.join(F.broadcast(chosen), "_id")
    total = picked.agg(F.sum(F.length("_text"))).first()[0] or 0
    if total > fit_characters:
        picked = picked.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * fit_characters / total))
    rows = picked.orderBy("_id").toArrow()
    return train(rows.column("_text").combine_chunks(), rows.column("_label").to_numpy().astype(np.int64))


def toxicity_scores(docs: DataFrame, network: Network, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, the largest chance over all overlapping windows of the whole text.

    Null and empty texts are scored as one window without words; repeated rows
    and ids get a score each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score_texts(shared.value, batch.column("text")))], names=["id", "score"])

    return rows.mapInArrow(work, f"id {docs.schema[id_column].dataType.simpleString()}, score double")
