"""Tricube-weighted sums over ranges of rows, from moments of nested halves instead of row by row.

The weight (1 - a^3)^3 of a scaled distance a is a polynomial, so a weighted sum over rows on one side of a point follows from the rows'
power sums up to the 11th. A tree holds them for every pair of rows, every pair of pairs, and so on, each about the
middle of its own rows and scaled by their reach. A range is made of at most two nodes per level. All rows of a node lie in the range, so
neither the node's reach nor its distance from the point exceeds the range's: shifting its moments there
adds up numbers of at most 1 and loses no digits, however irregular the times are.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np

POWERS = 12
_BINOMIAL = [[float(comb(q, p)) for p in range(q + 1)] for q in range(POWERS)]
_ROWS = 32_768


@dataclass(frozen=True)
class Nodes:
    """First and last time of the rows of each node, and power sums of its weights (``mu``) and weighted values (``nu``) by power and node.

    The powers are of (time - middle) / half of the span.
    """

    low: np.ndarray
    high: np.ndarray
    mu: np.ndarray
    nu: np.ndarray

    @property
    def middle(self) -> np.ndarray:
        return 0.5 * (self.low + self.high)

    @property
    def half(self) -> np.ndarray:
        return 0.5 * (self.high - self.low)

    def __len__(self) -> int:
        return len(self.low)


def points(t: np.ndarray, y: np.ndarray, w: np.ndarray) -> Nodes:
    """One node per row."""
    mu = np.zeros((POWERS, len(t)))
    nu = np.zeros((POWERS, len(t)))
    mu[0], nu[0] = w, np.where(w > 0, w * y, 0.0)
    return Nodes(t, t, mu, nu)


def shift(sums: np.ndarray, scale: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Power sums of ``scale`` * x + ``by`` from those of x."""
    out = np.empty_like(sums)
    scaled, power = sums.copy(), np.ones_like(scale)
    for p in range(1, POWERS):
        power = power * scale
        scaled[p] *= power
    shifts = [np.ones_like(by)]
    for _ in range(1, POWERS):
        shifts.append(shifts[-1] * by)
    for q in range(POWERS):
        total = scaled[q].copy()
        for p in range(q):
            total += _BINOMIAL[q][p] * shifts[q - p] * scaled[p]
        out[q] = total
    return out


def _parents(nodes: Nodes) -> Nodes:
    n = len(nodes) // 2 * 2
    low, high = nodes.low[0:n:2], nodes.high[1:n:2]
    middle, half = 0.5 * (low + high), 0.5 * (high - low)
    unit = np.where(half > 0, half, 1.0)
    mu = nu = 0.0
    for k in (0, 1):
        scale, by = nodes.half[k:n:2] / unit, (nodes.middle[k:n:2] - middle) / unit
        mu = mu + shift(nodes.mu[:, k:n:2], scale, by)
        nu = nu + shift(nodes.nu[:, k:n:2], scale, by)
    return Nodes(low, high, mu, nu)


def whole(nodes: Nodes) -> Nodes:
    """One node of all ``nodes``, in time order."""
    while len(nodes) > 1:
        rest = len(nodes) % 2
        last = Nodes(nodes.low[-1:], nodes.high[-1:], nodes.mu[:, -1:], nodes.nu[:, -1:])
        nodes = _parents(nodes)
        if rest:
            nodes = Nodes(np.append(nodes.low, last.low), np.append(nodes.high, last.high),
                          np.concatenate([nodes.mu, last.mu], axis=1), np.concatenate([nodes.nu, last.nu], axis=1))
    return nodes


class Tree:
    """All levels over ``nodes`` in time order; ``used`` counts the nodes that sums were made of."""

    def __init__(self, nodes: Nodes):
        self.levels, self.used = [nodes], 0
        while len(self.levels[-1]) > 1:
            self.levels.append(_parents(self.levels[-1]))

    def _add(self, out: np.ndarray, rows: np.ndarray, nodes: Nodes, node: np.ndarray, at: np.ndarray, reach: np.ndarray, side: float) -> None:
        if not len(rows):
            return
        self.used += len(rows)
        unit = reach[rows]
        scale, by = side * nodes.half[node] / unit, side * (nodes.middle[node] - at[rows]) / unit
        a, b = shift(nodes.mu[:, node], scale, by), shift(nodes.nu[:, node], scale, by)
        tricube = lambda x, k: x[k] - 3.0 * x[k + 3] + 3.0 * x[k + 6] - x[k + 9]
        out[:, rows] += (tricube(a, 0), side * tricube(a, 1), tricube(a, 2), tricube(b, 0), side * tricube(b, 1))

    def sums(self, start: np.ndarray, stop: np.ndarray, at: np.ndarray, reach: np.ndarray, side: int) -> np.ndarray:
        """Sums of w, wu, wuu, wy and wuy over the nodes ``start`` to ``stop`` (exclusive) of each row.

        u is the distance from ``at`` over ``reach``; all rows of the range lie on one ``side`` (-1 before, 1 behind) of ``at``.
        """
        out = np.zeros((5, len(at)))
        for a in range(0, len(at), _ROWS):
            part = slice(a, a + _ROWS)
            low, high = start[part].astype(np.int64), np.maximum(stop[part], start[part]).astype(np.int64)
            here, unit = at[part], np.where(reach[part] > 0, reach[part], 1.0)
            for nodes in self.levels:
                rows = np.flatnonzero((low < high) & (low % 2 == 1))
                self._add(out[:, part], rows, nodes, low[rows], here, unit, float(side))
                low[rows] += 1
                rows = np.flatnonzero((low < high) & (high % 2 == 1))
                high[rows] -= 1
                self._add(out[:, part], rows, nodes, high[rows], here, unit, float(side))
                low, high = low // 2, high // 2
                if not (low < high).any():
                    break
        return out

    def around(self, start: np.ndarray, stop: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """``sums`` of ranges of single rows that may lie on both sides of ``at``."""
        turn = np.clip(np.searchsorted(self.levels[0].low, at, side="right"), start, np.maximum(stop, start))
        return self.sums(start, turn, at, reach, -1) + self.sums(turn, stop, at, reach, 1)
