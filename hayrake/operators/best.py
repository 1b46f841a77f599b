"""The k best of every query within a task, from scores that come in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that wait before they are cut to the best, and most rows of a batch that a task returns.
WAITING, SLICE = 1 << 20, 1 << 17


class Best:
    """k scores per query, ties by key.  What cannot be among them any more is left out at once, so few scores are ever sorted."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.most = max(WAITING, 2 * queries * k)
        self.rows, self.waiting = [], 0

    def add(self, lo: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores (queries from ``lo``, documents); -inf is no score."""
        floor = self.floor[lo : lo + len(scores)]
        if scores.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, d = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.rows.append((q + lo, keys[d], scores[q, d]))
        self.waiting += len(q)
        if self.waiting > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, key, score = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((key, -score, q))
        q, key, score = q[order], key[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.floor) + 1))
        kept = np.arange(len(q)) - first[q] < self.k
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = score[first[full] + self.k - 1]
        self.rows, self.waiting = [(q[kept], key[kept], score[kept])], int(kept.sum())
        return self.rows[0]

    def batches(self, names: pa.Array, q_key: str, key: str):
        yield from batches(names, *self.cut(), q_key, key)


def batches(names: pa.Array, q: np.ndarray, keys: np.ndarray, scores: np.ndarray, q_key: str, key: str):
    """(q_key, key, score) in slices."""
    for lo in range(0, len(q), SLICE):
        at = slice(lo, lo + SLICE)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(q[at])), pa.array(keys[at]), pa.array(scores[at])], names=[q_key, key, "score"])
