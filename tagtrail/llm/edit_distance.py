"""Banded bit-parallel edit distance of many pairs at once.

Bit k of a word stands for row j - d + k of column j, so that the 2 * d + 1 diagonals that a distance of at most d can
use lie in one word, and a step to the next column shifts the band by one. All pairs of a batch advance together.
"""

from __future__ import annotations

import numpy as np


def _codes(texts: list[str], width: int, pad: int, front: int) -> np.ndarray:
    """Code points in a table with ``front`` columns of padding before and the rest behind."""
    out = np.full((len(texts), front + width), pad, dtype=np.int32)
    for k, text in enumerate(texts):
        own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[k, front : front + len(own)] = own
    return out


def within(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Edit distance of each pair, or ``most + 1`` where it is larger. ``most`` is at most 31."""
    if not a:
        return np.zeros(0, dtype=np.int64)
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band = 2 * most + 1
    columns = int(n.max(initial=0))
    rows = _codes(a, max(int(m.max()), columns + band), -1, most)
    cols = _codes(b, columns, -2, 0)
    one, top = np.uint64(1), np.uint64(2 * most)
    full = np.uint64((1 << band) - 1)
    # Rows from 1 on rise by one in column 0; the band of column 1 begins at row 1 - most.
    plus = np.full(len(a), (((1 << (most + 1)) - 1) << most) & int(full), dtype=np.uint64)
    minus = np.zeros(len(a), dtype=np.uint64)
    score = np.full(len(a), most, dtype=np.int64)  # of row j + most in column j
    out = np.full(len(a), most + 1, dtype=np.int64)

    def finish(at: np.ndarray) -> None:
        """From row n + most of the last column up to row m, by the vertical differences of the band."""
        value = score[at].copy()
        for k in range(band - 1):
            inside = k >= (m[at] - n[at] + most)
            rise = ((plus[at] >> np.uint64(k)) & one).astype(np.int64) - ((minus[at] >> np.uint64(k)) & one).astype(np.int64)
            value -= np.where(inside, rise, 0)
        out[at] = np.minimum(value, most + 1)

    fits = np.abs(m - n) <= most
    finish(np.flatnonzero(fits & (n == 0)))
    for j in range(1, columns + 1):
        equal = np.zeros(len(a), dtype=np.uint64)
        for k in range(band):
            equal |= (rows[:, j - 1 + k] == cols[:, j - 1]).astype(np.uint64) << np.uint64(k)
        across = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        up, down = (minus | ~(across | plus)) & full, across & plus
        score += 1 - ((across >> top) & one).astype(np.int64)
        plus, minus = (down | ~((across >> one) | up)) & full, (across >> one) & up
        ended = np.flatnonzero(fits & (n == j))
        if len(ended):
            finish(ended)
    return out
