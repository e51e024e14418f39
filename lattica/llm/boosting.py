"""Boosted trees over a table of counted feature combinations, and their score as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    names: list[str]
    start: float
    trees: list[tuple]  # ("leaf", value) or ("split", feature, threshold, low, high)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self) -> str:
        """The raw score over columns of the features' names."""
        return " + ".join([f"CAST({self.start!r} AS DOUBLE)", *(self._sql(t) for t in self.trees)])

    def _sql(self, t: tuple) -> str:
        if t[0] == "leaf":
            return f"CAST({float(t[1])!r} AS DOUBLE)"
        return f"CASE WHEN {self.names[t[1]]} <= {t[2]} THEN {self._sql(t[3])} ELSE {self._sql(t[4])} END"


def _apply(t: tuple, x: np.ndarray) -> np.ndarray:
    if t[0] == "leaf":
        return np.full(len(x), t[1])
    return np.where(x[:, t[1]] <= t[2], _apply(t[3], x), _apply(t[4], x))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float) -> tuple:
    g, h = slope.sum(), curve.sum()
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1].tolist():
                low = x[:, f] <= t
                gl, hl = slope[low].sum(), curve[low].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0]:
                    best = (gain, f, t)
    if best[1] is None:
        return ("leaf", rate * g / (h + 1))
    low = x[:, best[1]] <= best[2]
    return ("split", best[1], best[2], _grow(x[low], slope[low], curve[low], depth - 1, rate), _grow(x[~low], slope[~low], curve[~low], depth - 1, rate))


def boost(names: list[str], x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.4) -> Trees:
    """Logistic gradient boosting; ``x``: integer feature combinations, ``good`` and ``bad``: how many of each class have it."""
    total = good.sum() + bad.sum()
    share = (good.sum() + 1) / (total + 2)
    model = Trees(names, float(np.log(share / (1 - share))), [])
    score = np.full(len(x), model.start)
    for _ in range(rounds if total else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, good - (good + bad) * p, (good + bad) * p * (1 - p), depth, rate)
        model.trees.append(tree)
        score += _apply(tree, x)
    return model
