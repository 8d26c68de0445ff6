"""Points in small groups that lie close together, so that searches leave out what is too far."""

from __future__ import annotations

import numpy as np


def leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of ``x`` in groups of at most ``size``, halved along the widest side."""
    found, todo = [], [np.arange(len(x))]
    while todo:
        r = todo.pop()
        if len(r) <= size:
            found.append(r)
            continue
        side = np.ptp(x[r], axis=0).argmax()
        half = len(r) // 2
        by = np.argpartition(x[r, side], half)
        todo += [r[by[half:]], r[by[:half]]]
    return found


def corners(x: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest values of each group's rows."""
    return np.array([x[r].min(0) for r in groups]), np.array([x[r].max(0) for r in groups])


def gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """By side, how far lo to hi lies from low to high, 0 if they meet: no difference of two values is less."""
    return np.maximum(np.maximum(low - hi, lo - high), 0)
