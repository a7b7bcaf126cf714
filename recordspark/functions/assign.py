"""Optimal bipartite assignment for small cost matrices (shortest augmenting paths)."""

from __future__ import annotations

import numpy as np


def best_assignment(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the one-to-one matching with the largest total of `score`, without pairs under `least`.

    Pairs under `least` count as 0, so leaving both ends single is as good as taking them.
    """
    rows, cols = score.shape
    if not rows or not cols:
        return []
    n = max(rows, cols)
    gain = np.zeros((n, n))
    gain[:rows, :cols] = np.where(score >= least, score, 0.0)
    cost = gain.max() - gain
    price_row, price_col, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for start in range(n):
        reach, parent, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, via, base = start, -1, 0.0
        while True:
            slack = base + cost[row] - price_row[row] - price_col
            better = ~done & (slack < reach)
            reach[better], parent[better] = slack[better], via
            open_reach = np.where(done, np.inf, reach)
            col = int(open_reach.argmin())
            base, done[col] = reach[col], True
            if owner[col] < 0:
                break
            row, via = int(owner[col]), col
        total = reach[col]
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                price_row[owner[c]] += total - reach[c]
            price_col[c] -= total - reach[c]
        price_row[start] += total
        while col >= 0:
            before = int(parent[col])
            owner[col] = owner[before] if before >= 0 else start
            col = before
    return sorted((int(owner[c]), c) for c in range(cols) if owner[c] < rows and score[owner[c], c] >= least)
