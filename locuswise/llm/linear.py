"""Logistic regression on sparse hashed features, with calibrated probabilities."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Fitted(NamedTuple):
    """Weights by hashed feature, bias, and the line that calibrates the log-odds."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class Rows(NamedTuple):
    """Sparse rows laid end to end: features, values, and where each row begins (one more entry at the end)."""

    at: np.ndarray
    value: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        bounds = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])]).astype(np.int64)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return Rows(join([a for a, _ in rows], np.int64), join([v for _, v in rows], np.float64), bounds)

    def take(self, chosen: np.ndarray) -> Rows:
        return Rows.of([(self.at[a:b], self.value[a:b]) for a, b in zip(self.bounds[:-1][chosen], self.bounds[1:][chosen], strict=True)])

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.bounds) - 1)
        full = np.diff(self.bounds) > 0
        if full.any():
            out[full] = np.add.reduceat(weights[self.at] * self.value, self.bounds[:-1][full])
        return out


def _descend(rows: Rows, y: np.ndarray, size: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient steps; rows have length 1 at most, so the slope changes by a quarter of the way at most."""
    n = len(y)
    owner = np.repeat(np.arange(n), np.diff(rows.bounds))
    weights, bias = np.zeros(size), 0.0
    ahead, ahead_bias = weights, bias
    rate = 1.0 / (0.5 + l2)
    for step in range(steps):
        error = 1 / (1 + np.exp(-np.clip(rows.margins(ahead) + ahead_bias, -30, 30))) - y
        slope = np.bincount(rows.at, weights=rows.value * error[owner], minlength=size) / n + l2 * ahead
        new, new_bias = ahead - rate * slope, ahead_bias - rate * error.mean()
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - weights), new_bias + push * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, bias


def calibrated_line(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds by Newton steps, with targets drawn a little off 0 and 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(y))])
    line = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        line += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(line[0]), float(line[1])


def fit(rows: Rows, y: np.ndarray, size: int, l2: float = 1e-5, steps: int = 400, parts: int = 5) -> Fitted:
    """Fit on all rows; calibrate on margins that a fit without the row's part gives (two parts suffice for small sets).

    With one class only, or no rows, every probability is the share of that class.
    """
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Fitted(np.zeros(size), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = np.zeros(len(y))
    part = np.arange(len(y)) % parts
    for k in range(parts):
        out = part == k
        if not out.any() or y[~out].min() == y[~out].max():
            continue
        weights, bias = _descend(rows.take(np.flatnonzero(~out)), y[~out], size, l2, steps // 2)
        held[out] = rows.take(np.flatnonzero(out)).margins(weights) + bias
    slope, offset = calibrated_line(held, y)
    weights, bias = _descend(rows, y, size, l2, steps)
    return Fitted(weights, bias, max(slope, 0.0), offset)
