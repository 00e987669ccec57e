"""Places of many points on a Hilbert curve in any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """One key per row of ``cells`` (numbers under ``2 ** bits``); keys sort as their points follow on the curve.

    The reflections and exchanges that turn the curve's corners are undone bit by
    bit from the top, for all points at a time; a Gray code then gives the place,
    whose bits go dimension by dimension, highest first.
    """
    count, width = cells.shape
    if not width:
        return [b""] * count
    x = cells.T.astype(np.uint32).copy()  # one line per dimension
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(width):
            flipped = (x[d] & bit) != 0
            swap = np.where(flipped, np.uint32(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(flipped, below, swap)
            if d:
                x[d] ^= swap
    for d in range(1, width):
        x[d] ^= x[d - 1]
    turn = np.zeros(count, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    plane = ((x.T[:, None, :] >> levels[None, :, None]) & np.uint32(1)).astype(np.uint8)
    packed = np.packbits(plane.reshape(count, -1), axis=1)
    return [row.tobytes() for row in packed]
