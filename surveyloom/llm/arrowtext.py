"""Arrow helpers for operators that read texts in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once; bounds a worker's memory whatever a batch holds.
CHUNK_BYTES = 4_000_000


def chunks(batches: Iterator[pa.RecordBatch], text_column: str = "text",
           chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of some ``chunk_bytes`` of text each, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text_column)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // chunk_bytes
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, split at ASCII white space, and the place where each text's words end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = split.flatten(), split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
    full = pc.not_equal(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        flat = flat.filter(full)
    return flat, ends


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words as numbers, and the distinct words those stand for."""
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
