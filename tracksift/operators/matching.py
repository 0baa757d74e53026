"""Maximum-weight matching in a small bipartite graph."""

from __future__ import annotations

import math


def best_matching(weights: dict[tuple[int, int], float], n_left: int, n_right: int) -> list[tuple[int, int]]:
    """Pairs of the matching with most pairs and, among those, most weight.

    ``weights`` has the allowed pairs with weights in [0, 1]. Shortest
    augmenting paths with potentials; absent pairs cost more than any set of
    allowed ones, so they are only used to fill up and left out of the result.
    """
    if not weights:
        return []
    flip = n_left > n_right
    if flip:
        weights = {(b, a): w for (a, b), w in weights.items()}
        n_left, n_right = n_right, n_left
    absent = 2.0 * (n_left + n_right)
    cost = [[1.0 - weights[a, b] if (a, b) in weights else absent for b in range(n_right)] for a in range(n_left)]
    pot_l, pot_r = [0.0] * (n_left + 1), [0.0] * (n_right + 1)
    owner, back = [0] * (n_right + 1), [0] * (n_right + 1)
    for a in range(1, n_left + 1):
        owner[0], at = a, 0
        dist, seen = [math.inf] * (n_right + 1), [False] * (n_right + 1)
        while owner[at]:
            seen[at], row = True, owner[at]
            step, nxt = math.inf, 0
            for b in range(1, n_right + 1):
                if not seen[b]:
                    d = cost[row - 1][b - 1] - pot_l[row] - pot_r[b]
                    if d < dist[b]:
                        dist[b], back[b] = d, at
                    if dist[b] < step:
                        step, nxt = dist[b], b
            for b in range(n_right + 1):
                if seen[b]:
                    pot_l[owner[b]] += step
                    pot_r[b] -= step
                else:
                    dist[b] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(owner[b] - 1, b - 1) for b in range(1, n_right + 1) if owner[b]]
    pairs = [p for p in pairs if p in weights]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)
