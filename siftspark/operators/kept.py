"""Ids of the rows that a task keeps as the best of its queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class KeptIds:
    """Ids by their number in the order of arrival; those of rows no query keeps are dropped when there are many."""

    def __init__(self, slack: int = 262_144) -> None:
        self.parts: list[pa.Array] = []
        self.n, self.slack = 0, slack

    def add(self, ids: pa.Array) -> None:
        self.parts.append(ids)
        self.n += len(ids)

    def compact(self, which: np.ndarray) -> np.ndarray:
        """The numbers in ``which`` (-1: none), renewed if ids were dropped; their order stays."""
        if self.n <= 4 * which.size + self.slack:
            return which
        used, at = np.unique(which, return_inverse=True)
        gone = int(used[0] < 0)
        self.parts, self.n = [pa.concat_arrays(self.parts).take(pa.array(used[gone:]))], len(used) - gone
        return at.reshape(which.shape) - gone

    def all(self) -> pa.Array:
        return pa.concat_arrays(self.parts)
