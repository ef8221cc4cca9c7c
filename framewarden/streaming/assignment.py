"""Optimal one-to-one assignment where leaving a pair apart costs a limit."""

from __future__ import annotations

import numpy as np

INF = float("inf")
#: Sides of squares that are solved on lists.
SMALL = 24


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) that maximise the sum of limit - cost over pairs of cost < limit.

    Rows and columns that no pair worth making connects don't bear on each other: each such part is solved by itself. Where all
    rows of a part (or all columns) like different partners best there is nothing to solve."""
    at_rows, at_columns = np.nonzero(cost < limit)
    if not len(at_rows):
        return []
    gains: dict[int, dict[int, float]] = {}
    for r, c, gain in zip(at_rows.tolist(), at_columns.tolist(), (limit - cost[at_rows, at_columns]).tolist(), strict=True):
        gains.setdefault(r, {})[c] = gain
    out: list[tuple[int, int]] = []
    for rows, columns in _parts(gains):
        pairs = _favourites({r: gains[r] for r in rows})
        if pairs is None:
            turned = _favourites({c: {r: gains[r][c] for r in rows if c in gains[r]} for c in columns})
            pairs = None if turned is None else [(r, c) for c, r in turned]
        if pairs is None:
            some = _solve(cost[np.ix_(rows, columns)], limit)
            pairs = [(rows[i], columns[j]) for i, j in some]
        out += pairs
    return sorted(out)


def _parts(gains: dict[int, dict[int, float]]) -> list[tuple[list[int], list[int]]]:
    """The connected parts, as their rows and columns."""
    by_column: dict[int, list[int]] = {}
    for r, to in gains.items():
        for c in to:
            by_column.setdefault(c, []).append(r)
    out, seen = [], set()
    for start in gains:
        if start in seen:
            continue
        seen.add(start)
        rows, columns, todo = [start], set(), [start]
        while todo:
            for c in gains[todo.pop()]:
                if c not in columns:
                    columns.add(c)
                    new = [r for r in by_column[c] if r not in seen]
                    seen.update(new)
                    rows += new
                    todo += new
        out.append((sorted(rows), sorted(columns)))
    return out


def _favourites(gains: dict[int, dict[int, float]]) -> list[tuple[int, int]] | None:
    """Each one with the partner of its largest gain, if these are different and no other gain is as large."""
    out, taken = [], set()
    for one, to in gains.items():
        most = max(to.values())
        best = [k for k, gain in to.items() if gain == most]
        if len(best) > 1 or best[0] in taken:
            return None
        taken.add(best[0])
        out.append((one, best[0]))
    return out


def _solve(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Shortest augmenting paths with potentials on the gains padded to a square; padding and bad pairs gain nothing."""
    rows, columns = cost.shape
    n = max(rows, columns)
    loss = np.zeros((n, n))
    loss[:rows, :columns] = -np.maximum(0.0, limit - cost)
    if n <= SMALL:
        match = _paths(loss.tolist(), n)
    else:
        match = _wide_paths(loss, n)
    pairs = [(match[j] - 1, j - 1) for j in range(1, columns + 1) if 0 < match[j] <= rows]
    return sorted((r, c) for r, c in pairs if cost[r, c] < limit)


def _paths(loss: list[list[float]], n: int) -> list[int]:
    """The row (from 1) of each column (from 1); the same steps as `_wide_paths` on lists, which are faster where n is small."""
    u, v = [0.0] * (n + 1), [0.0] * (n + 1)
    match, way = [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, free, used = [INF] * (n + 1), list(range(1, n + 1)), []
        while match[j0]:
            used.append(j0)
            if j0:
                free.remove(j0)
            row, base = loss[match[j0] - 1], u[match[j0]]
            step, j1 = INF, 0
            for j in free:
                now = row[j - 1] - base - v[j]
                if now < slack[j]:
                    slack[j], way[j] = now, j0
                if slack[j] < step:
                    step, j1 = slack[j], j
            for j in used:
                u[match[j]] += step
                v[j] -= step
            for j in free:
                slack[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match


def _wide_paths(loss: np.ndarray, n: int) -> list[int]:
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = loss[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = now < slack[free]
            slack[free[better]], way[free[better]] = now[better], j0
            j1 = free[slack[free].argmin()]
            step = slack[j1]
            u[match[used]] += step
            v[used] -= step
            slack[free] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return match.tolist()
