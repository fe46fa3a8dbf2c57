"""Spatial indexes in numpy: a bulk-loaded R-tree and a quadtree over a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class RTree:
    """Sort-tile-recursive R-tree over boxes, probed by many boxes at once."""

    def __init__(self, x0, y0, x1, y1, fill: int = 16):
        n, self.fill = len(x0), fill
        across = int(np.ceil(np.sqrt(np.ceil(n / fill)))) * fill  # entries in one vertical slice
        by_x = np.argsort(x0 + x1, kind="stable")
        self.order = by_x[np.lexsort(((y0 + y1)[by_x], np.arange(n) // max(across, 1)))] if n else by_x
        level = tuple(a[self.order] for a in (x0, y0, x1, y1))
        self.levels = [level]
        while len(level[0]) > fill:
            at = np.arange(0, len(level[0]), fill)
            level = (np.minimum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def probe(self, x0, y0, x1, y1, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (probe, entry) of overlapping boxes, in pieces of bounded size."""
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        if not width:
            return
        step = max(1, most // width)
        stack = []
        for s in range(0, len(x0), step):
            q = np.arange(s, min(s + step, len(x0)))
            stack.append((top, np.repeat(q, width), np.tile(np.arange(width), len(q))))
            while stack:
                at, q, node = stack.pop()
                a, b, c, d = self.levels[at]
                hit = (a[node] <= x1[q]) & (c[node] >= x0[q]) & (b[node] <= y1[q]) & (d[node] >= y0[q])
                q, node = q[hit], node[hit]
                if not len(q):
                    continue
                if at == 0:
                    yield q, self.order[node]
                    continue
                below = len(self.levels[at - 1][0])
                for p in range(0, len(q), max(1, most // self.fill)):
                    part = slice(p, p + max(1, most // self.fill))
                    child = (node[part, None] * self.fill + np.arange(self.fill)).ravel()
                    stack.append((at - 1, np.repeat(q[part], self.fill)[child < below], child[child < below]))


class Quadtree:
    """Cells of about equal numbers of points, split where a sample is dense.

    A cell is not split below ``least`` degrees (height, and width at its latitude), so that boundary replication stays
    small; one that several persons crowd (over eight times ``capacity`` beside the largest person) may go down to a
    quarter of that. A cell that still holds too much gets ``shares`` > 1: of these, ``pure[cell, person] = (first,
    number)`` belong to one person each, the others (the first ``mixed[cell]``) to all the rest.
    """

    BOX = (-180.0, -90.0, 180.0, 90.0)

    def __init__(self, x, y, weight: float, capacity: int, least: float, deepest: int = 24, who=None):
        self.x0, self.y0, self.x1, self.y1 = ([v] for v in self.BOX)
        self.child, self.leaf, self.shares, self.mixed = [-1], [-1], [], []
        self.pure: dict[tuple[int, str], tuple[int, int]] = {}
        work = [(0, np.arange(len(x)), 0)]
        x, y = np.asarray(x), np.asarray(y)
        names, person = np.unique(np.asarray(who, dtype=str), return_inverse=True) if who is not None and len(x) else (np.empty(0, str), None)
        while work:
            node, idx, depth = work.pop()
            a, b, c, d = self.x0[node], self.y0[node], self.x1[node], self.y1[node]
            mx, my = (a + c) / 2, (b + d) / 2
            squeeze = max(np.cos(np.radians(min(89.9, max(abs(b), abs(d))))), 1e-6)
            few = least
            if (d - b) / 2 < least and len(idx) * weight > 8 * capacity:
                largest = np.bincount(person[idx]).max() if person is not None else 0
                few = least / 4 if (len(idx) - largest) * weight > 8 * capacity else least
            if len(idx) * weight > capacity and depth < deepest and (d - b) / 2 >= few and (c - a) / 2 >= few / squeeze:
                self.child[node] = len(self.x0)
                east, north = x[idx] >= mx, y[idx] >= my
                for q in range(4):
                    e, u = bool(q & 1), bool(q & 2)
                    for side, v in zip((self.x0, self.y0, self.x1, self.y1), (mx if e else a, my if u else b, c if e else mx, d if u else my)):
                        side.append(v)
                    self.child.append(-1)
                    self.leaf.append(-1)
                    work.append((len(self.x0) - 1, idx[(east == e) & (north == u)], depth + 1))
            else:
                cell = self.leaf[node] = len(self.shares)
                rest, total = len(idx), 0
                if rest * weight > 2 * capacity and person is not None:
                    count = np.bincount(person[idx], minlength=len(names))
                    own = np.flatnonzero(count * weight >= 2 * capacity)
                    rest -= int(count[own].sum())
                mixed = total = max(1, int(np.ceil(rest * weight / (2 * capacity))))
                if rest < len(idx):
                    for h in own:
                        n = int(np.ceil(count[h] * weight / (2 * capacity)))
                        self.pure[cell, str(names[h])] = (total, n)
                        total += n
                self.shares.append(total)
                self.mixed.append(mixed)
        for name in ("x0", "y0", "x1", "y1", "child", "leaf", "shares", "mixed"):
            setattr(self, name, np.asarray(getattr(self, name)))

    def boxes(self) -> tuple[np.ndarray, ...]:
        """``x0, y0, x1, y1`` of each cell."""
        at = np.flatnonzero(self.leaf >= 0)
        at = at[np.argsort(self.leaf[at])]
        return self.x0[at], self.y0[at], self.x1[at], self.y1[at]

    def home(self, x, y) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(x), int)
        while len(at := np.flatnonzero(self.child[node] >= 0)):
            n = node[at]
            mx, my = (self.x0[n] + self.x1[n]) / 2, (self.y0[n] + self.y1[n]) / 2
            node[at] = self.child[n] + (x[at] >= mx) + 2 * (y[at] >= my)
        return self.leaf[node]

    def overlaps(self, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, cell) that meet."""
        q, node = np.arange(len(x0)), np.zeros(len(x0), int)
        got_q, got_c = [q[:0]], [node[:0]]
        while len(q):
            hit = (self.x0[node] <= x1[q]) & (self.x1[node] >= x0[q]) & (self.y0[node] <= y1[q]) & (self.y1[node] >= y0[q])
            q, node = q[hit], node[hit]
            end = self.child[node] < 0
            got_q.append(q[end])
            got_c.append(self.leaf[node[end]])
            q, node = np.repeat(q[~end], 4), (self.child[node[~end]][:, None] + np.arange(4)).ravel()
        return np.concatenate(got_q), np.concatenate(got_c)
