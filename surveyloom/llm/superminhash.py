"""Word shingles and SuperMinHash signatures of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from surveyloom.llm.arrowtext import coded, words_of

_ODD = 0x9E3779B97F4A7C15


def _multiple(k: int) -> np.uint64:
    return np.uint64(_ODD * k % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any change over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text.

    A text of fewer than ``width`` words has its whole sequence as one shingle;
    one without words has none.
    """
    words, ends = words_of(texts)
    codes, distinct = coded(words)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], dtype=np.uint64)
    word = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    runs = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    factors = np.array([pow(_ODD, k + 1, 1 << 64) for k in range(width)], dtype=np.uint64)
    for k in range(width):
        runs += word[k:k + len(runs)] * factors[k]
    runs = mixed(runs)
    sets = []
    for first, last in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        count = last - first
        if count >= width:
            sets.append(np.unique(runs[first:last - width + 1]))
        elif count:
            short = (word[first:last] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            sets.append(mixed(np.array([short], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` numbers per set.

    Every element walks through its own random permutation of the slots, drawn
    step by step from its hash, and at step j offers j plus a random fraction
    to the slot it meets.  An offer of a later step never beats an earlier
    one, so a set stops as soon as all its slots are taken: large sets after one
    step, single elements after ``size``.  Empty sets have no meaningful row.
    """
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    signature = np.full((len(sets), size), np.iinfo(np.int64).max, dtype=np.int64)
    flat = signature.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), lengths)
    order = None
    for step in range(size):
        if not len(element):
            break
        draw = mixed(element + _multiple(step + 1))
        pick = step + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - step)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            line = np.arange(len(element))
            slot = order[line, pick].astype(np.int64)
            order[line, pick] = order[line, step]
            order[line, step] = slot
        offer = (np.int64(step) << np.int64(32)) + (draw >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, owner * size + slot, offer)
        open_sets = (signature == np.iinfo(np.int64).max).any(axis=1)
        stay = open_sets[owner]
        if order is None:
            first = pick[stay]
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(first), 1))
            line = np.arange(len(first))
            order[line, first] = 0
            order[:, 0] = first
        elif not stay.all():
            order = order[stay]
        if not stay.all():
            element, owner = element[stay], owner[stay]
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` numbers; the band's number is part of it."""
    bands = signature.shape[1] // rows
    part = signature[:, :bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.array([_multiple(b + 1) for b in range(bands)], dtype=np.uint64), part.shape[:2])
    for k in range(rows):
        key = mixed(key + mixed(part[:, :, k] + _multiple(k + 1)))
    return key.astype(np.int64)
