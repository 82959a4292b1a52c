"""Sparse rows in numpy, for the classifiers that are trained on a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Row i has the features ids[ptr[i]:ptr[i+1]] with the values vals[...]; no row is empty."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.ptr = np.cumsum([0, *(len(i) for i, _ in rows)])
        self.ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.vals = np.concatenate([v for _, v in rows]).astype(np.float32) if rows else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, vals, each entry's place in ``rows``, and where each row begins."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(starts - self.ptr[rows], n)
        return self.ids[at], self.vals[at], np.repeat(np.arange(len(rows)), n), starts


def scatter(ids: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by id."""
    if values.ndim == 1:
        return np.bincount(ids, values, size).astype(np.float32)
    return np.stack([np.bincount(ids, values[:, k], size) for k in range(values.shape[1])], 1).astype(np.float32)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-6)


def sigmoid(z):  # noqa: ANN001, ANN201
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
