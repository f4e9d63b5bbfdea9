"""Hilbert keys of integer points, vectorised over rows."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of ``cells`` on the Hilbert curve.

    ``cells`` holds unsigned integers below ``2**bits``, one column per axis; ``bits`` times the
    number of axes may be 63 at most. The Gray-code transform works on all rows at once: for every
    bit plane the lower bits are inverted or exchanged with the first axis, and the transposed
    planes are then read from the highest to the lowest.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    if bits * axes > 63:
        raise ValueError("a Hilbert key holds 63 bits at most")
    for plane in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << plane, (np.int64(1) << plane) - 1
        for a in range(axes):
            high = (x[a] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(high, low, swap)
            if a:
                x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1, (np.int64(1) << plane) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << 1) | ((x[a] >> plane) & 1)
    return key
