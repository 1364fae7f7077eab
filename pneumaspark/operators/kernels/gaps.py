"""Filters over what has been measured: each column's finite runs, with the gaps put back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def filter_runs(grid: np.ndarray, apply: Callable[[np.ndarray], np.ndarray], least: int, keep_short: bool = False) -> np.ndarray:
    """A (time, column) array with ``apply`` over each finite run of ``least`` samples or more; missing samples stay missing.

    A run too short to be filtered becomes missing too, or stays as it was if ``keep_short``.
    """
    out = np.full(grid.shape, np.nan)
    finite = np.isfinite(grid)
    for c in range(grid.shape[1]):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], finite[:, c], [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= least:
                out[a:b, c] = apply(grid[a:b, c])
            elif keep_short:
                out[a:b, c] = grid[a:b, c]
    return out
