"""The k best of many queries over a stream of batches: what a task keeps of the rows that it scored.

A task holds k rows a query, whatever it reads, and sends these alone.  Scores count as SQL rounds them, so that ties are
those of the result: to ``PLACES`` places, halves away from zero; NaN is above all, NULL below, and equal scores go by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PLACES = 6
NULL, NAN, NOBODY = -np.inf, np.inf, np.iinfo(np.int64).max


def rounded(x: np.ndarray) -> np.ndarray:
    unit = 10.0**PLACES
    return np.copysign(np.floor(np.abs(x) * unit + 0.5) / unit, x) + 0.0  # no -0.0


class Best:
    """The k best of each of n queries so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NULL)
        self.ids = np.full((n, k), NOBODY, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """scores (queries x rows), not rounded, of rows with these ids; ``queries`` says which, else all."""
        which = np.arange(len(self.ids)) if queries is None else queries
        if not len(ids) or not len(which):
            return
        least = self.score[which, -1] - 10.0**-PLACES
        if len(ids) > self.k and (self.ids[which, -1] == NOBODY).any():
            # No row under the k-th best of a batch can be one of the k best of all.
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 10.0**-PLACES)
        row, col = np.nonzero(scores >= least[:, None])
        score, at = rounded(scores[row, col]), ids[col]
        last, last_id = self.score[which, -1][row], self.ids[which, -1][row]
        able = (score > last) | ((score == last) & (at < last_id))
        row, score, at = row[able], score[able], at[able]
        if not len(row):
            return
        own, row = np.unique(row, return_inverse=True)
        held = which[own]
        row = np.concatenate((np.repeat(np.arange(len(own)), self.k), row))
        score, at = np.concatenate((self.score[held].ravel(), score)), np.concatenate((self.ids[held].ravel(), at))
        order = np.lexsort((at, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.score[held], self.ids[held] = score[order].reshape(-1, self.k), at[order].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Which query, which row, and its score."""
        q, nth = np.nonzero(self.ids != NOBODY)
        score = self.score[q, nth]
        return q, self.ids[q, nth], pa.array(np.where(score == NAN, np.nan, score), mask=score == NULL)
