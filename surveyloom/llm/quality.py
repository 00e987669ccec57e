"""Quality of texts from an additive model on text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import gam
from surveyloom.llm.arrowtext import chunks, coded, words_of
from surveyloom.llm.common import whole_text

# Labelled rows the model is fitted on; chosen by a hash of the id where there are more.
FIT_ROWS = 20_000
THRESHOLD = 0.7

FEATURES = ["log_words", "word_bytes", "distinct_words", "repeated_words", "repeated_pairs", "commonest_word",
            "capitals", "digits", "marks", "shouts", "bars", "symbols", "beyond_ascii", "stops", "distinct_lines",
            "short_lines", "line_words"]

_CLASSES = {"capitals": range(65, 91), "digits": range(48, 58),
            "marks": [c for c in range(33, 127) if not chr(c).isalnum()], "shouts": b"!", "bars": b"|",
            "symbols": b"#$%&*", "beyond_ascii": range(128, 256), "stops": b".,"}


def _byte_shares(texts: pa.Array) -> dict[str, np.ndarray]:
    """Share of each class of bytes in every text, out of the bytes that are not white space."""
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    ends = offsets[1:] - offsets[0]

    def per_text(member: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
        return np.diff(run[np.concatenate([[0], ends])]).astype(np.float64)

    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    whole = np.maximum(per_text(solid), 1)
    out = {"bytes": whole}
    for name, members in _CLASSES.items():
        member = np.zeros(256, bool)
        member[list(members)] = True
        out[name] = per_text(member) / whole
    return out


def _word_shares(texts: pa.Array) -> dict[str, np.ndarray]:
    words, ends = words_of(texts)
    codes, _ = coded(words)
    starts = np.concatenate([[0], ends[:-1]])
    count = (ends - starts).astype(np.float64)
    # Occurrences of each word in its text, from one sort of (text, word) pairs.
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    size = int(codes.max()) + 1 if len(codes) else 1
    keys, times = np.unique(owner * size + codes, return_counts=True)
    of = keys // size
    distinct = np.bincount(of, minlength=len(ends))
    commonest = np.zeros(len(ends))
    np.maximum.at(commonest, of, times)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(ends))
    if len(codes) > 1:
        inside = owner[1:] == owner[:-1]
        pair = owner[1:][inside] * size * size + codes[:-1][inside] * size + codes[1:][inside]
        fits = len(ends) * float(size) ** 2 < 2 ** 62
        pair = pair if fits else (codes[:-1][inside] * np.int64(1_000_003) + codes[1:][inside]) * 65_537 + owner[1:][inside]
        _, first = np.unique(pair, return_index=True)
        again = np.bincount(owner[1:][inside], minlength=len(ends)) - np.bincount(
            owner[1:][inside][first], minlength=len(ends))
    safe = np.maximum(count, 1)
    return {"words": count, "distinct_words": distinct / safe, "commonest_word": commonest / safe,
            "repeated_words": np.bincount(owner, same, len(ends)) / safe, "repeated_pairs": again / safe}


def _line_shares(texts: pa.Array) -> dict[str, np.ndarray]:
    split = pc.split_pattern(texts, "\n")
    ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
    starts = np.concatenate([[0], ends[:-1]])
    lines = split.flatten()
    codes, _ = coded(lines)
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    size = int(codes.max()) + 1 if len(codes) else 1
    distinct = np.bincount(np.unique(owner * size + codes) // size, minlength=len(ends))
    short = np.bincount(owner, pc.binary_length(lines).to_numpy(zero_copy_only=False) < 20, len(ends))
    count = np.maximum(ends - starts, 1)
    return {"lines": count, "distinct_lines": distinct / count, "short_lines": short / count}


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros and a single line."""
    found = _byte_shares(texts) | _word_shares(texts) | _line_shares(texts)
    found["log_words"] = np.log1p(found["words"])
    found["word_bytes"] = found["bytes"] / np.maximum(found["words"], 1)
    found["line_words"] = np.log1p(found["words"] / found["lines"])
    return np.column_stack([found[name] for name in FEATURES])


def describe(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and the features of every text."""
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            flat = features_of(batch.column("text")).reshape(-1)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["id", "features"])

    return rows.mapInArrow(work, f"id {docs.schema[id_column].dataType.simpleString()}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text",
        label_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> gam.Model:
    """Fit on labelled texts for which ``usable`` holds of the label's id.

    Null labels and ids are left out, and of an id labelled twice one label
    counts.  Above about ``fit_rows`` labels a hash of the id picks that many.
    """
    given = labels.where(usable & F.col(label).isNotNull() & F.col(label_id).isNotNull()).select(
        F.col(label_id).alias("_id"), F.col(label).cast("int").alias("_label")).dropDuplicates(["_id"])
    count = given.count()
    if count > fit_rows:
        part = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
        given = given.where(part < int(1_000_000 * fit_rows / count))
    # Bounded by ``fit_rows``, and so are the features that come to the driver.
    given = F.broadcast(given)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    found = describe(texts.join(given, "_id", "left_semi"), "_id", "_text").join(given, F.col("id") == F.col("_id"))
    rows = found.select("id", "features", "_label").toPandas().sort_values("id", kind="stable")
    features = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return gam.fit(features, rows["_label"].to_numpy(np.float64))


def scorer(model: gam.Model):
    """The model as a column function of the text; one pass over Arrow batches."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [model.score(features_of(part.column("text"))) for part in chunks(iter([batch]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, model: gam.Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, the chance of label 1.

    Null and empty texts are scored as texts without words; repeated rows and
    ids get a score each; a model without labels gives one half.  Other
    columns are not read.
    """
    return docs.select(F.col(id_column).alias("id"), scorer(model)(whole_text(text_column)).alias("score"))


def drop_low_quality(docs: DataFrame, model: gam.Model, text_column: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all columns; no row moves."""
    return docs.where(scorer(model)(whole_text(text_column)) >= threshold)
