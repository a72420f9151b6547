"""E8 lattice hashing of vectors: nearest lattice points of random projections, and neighbouring cells."""

from __future__ import annotations

import itertools

import numpy as np

from glazier.llm.common import mix64

DIM = 8


def _shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minus signs."""
    whole = [[a * (k == i) + b * (k == j) for k in range(DIM)]
             for i, j in itertools.combinations(range(DIM), 2) for a in (1, -1) for b in (1, -1)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=DIM) if np.prod(s) > 0]
    return np.array([*whole, *halves])


NEIGHBOURS = _shortest_vectors()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(axis=1) % 2)
    off = y[odd] - z[odd]
    worst = np.abs(off).argmax(axis=1)
    z[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return z


def nearest_points(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``y``: the even points or those shifted by one half."""
    a, b = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def _keys(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (any leading shape)."""
    key = np.full(points.shape[:-1], salt, np.uint64)
    for i in range(points.shape[-1]):
        key = mix64(key + (2 * points[..., i]).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return key


class LatticeTables:
    """``tables`` hash tables, each of ``blocks`` random 8-dimensional projections decoded to E8.

    ``scale`` is the projected length of a unit step against the lattice's cells: the larger, the
    finer.  ``probes`` neighbouring cells are named besides a vector's own: those whose lattice points
    come next nearest, over all blocks together."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int = 20):
        rng = np.random.default_rng([seed, dim])
        self.maps = rng.standard_normal((tables, blocks, dim, DIM)) * scale
        self.shifts = rng.random((tables, blocks, DIM))
        self.probes = probes

    def keys(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (rows, tables) and probed cells (rows, tables, probes) as 64-bit keys."""
        own, probed = [], []
        for table, (maps, shifts) in enumerate(zip(self.maps, self.shifts)):
            cells, near, cost = [], [], []
            for block, (m, shift) in enumerate(zip(maps, shifts)):
                y = unit @ m + shift
                point = nearest_points(y)
                # Squared distance to point + v less that to point is 2 - 2 (y - point).v
                extra = 2 - 2 * (y - point) @ NEIGHBOURS.T
                best = np.argsort(extra, axis=1, kind="stable")[:, :self.probes]
                cells.append(_keys(point, 7 * table + block))
                near.append(_keys(point[:, None, :] + NEIGHBOURS[best], 7 * table + block))
                cost.append(np.take_along_axis(extra, best, axis=1))
            own.append(_joined(cells))
            probed.append(self._cheapest(cells, near, cost))
        return np.stack(own, axis=1), np.stack(probed, axis=1)

    def _cheapest(self, cells, near, cost) -> np.ndarray:
        """Keys of the ``probes`` cheapest cells that differ from the own one in one block or in two."""
        keys, costs = [], []
        for b in range(len(cells)):
            for p in range(self.probes):
                keys.append(_joined([near[c][:, p] if c == b else cells[c] for c in range(len(cells))]))
                costs.append(cost[b][:, p])
        few = min(self.probes, 6)
        for b, c in itertools.combinations(range(len(cells)), 2):
            for p, q in itertools.product(range(few), repeat=2):
                keys.append(_joined([near[x][:, p] if x == b else near[x][:, q] if x == c else cells[x]
                                     for x in range(len(cells))]))
                costs.append(cost[b][:, p] + cost[c][:, q])
        keys, costs = np.stack(keys, axis=1), np.stack(costs, axis=1)
        return np.take_along_axis(keys, np.argsort(costs, axis=1, kind="stable")[:, :self.probes], axis=1)


def _joined(keys: list[np.ndarray]) -> np.ndarray:
    out = keys[0]
    for k in keys[1:]:
        out = mix64(out * np.uint64(3) + k)
    return out.view(np.int64)
