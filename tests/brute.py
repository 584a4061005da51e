"""Plain versions of the graph operators over dense matrices, to hold the DataFrame ones against."""

import itertools
import math

import numpy as np


def random_graph(rng, n, p, directed, loops=False):
    a = (rng.random((n, n)) < p).astype(float)
    if not directed:
        a = np.triu(a) + np.triu(a, 1).T
    if not loops:
        np.fill_diagonal(a, 0)
    return a


def bfs(a):
    n = len(a)
    d, c = np.full((n, n), math.inf), np.zeros((n, n))
    for s in range(n):
        d[s, s], c[s, s], front = 0, 1, [s]
        while front:
            new = []
            for u in front:
                for v in np.flatnonzero(a[u]):
                    if v != u and d[s, v] > d[s, u]:
                        if math.isinf(d[s, v]):
                            d[s, v] = d[s, u] + 1
                            new.append(v)
                        if d[s, v] == d[s, u] + 1:
                            c[s, v] += c[s, u]
            front = new
    return d, c


def betweenness(a):
    d, c = bfs(a)
    n = len(a)
    out = np.zeros(n)
    for s, v, t in itertools.permutations(range(n), 3):
        if d[s, v] + d[v, t] == d[s, t] < math.inf:
            out[v] += c[s, v] * c[v, t] / c[s, t]
    return out


def triad_counts(a):
    """Number of triads by (mutual, asymmetric, null) dyads."""
    out = {}
    for t in itertools.combinations(range(len(a)), 3):
        sums = [a[i, j] + a[j, i] for i, j in itertools.combinations(t, 2)]
        key = (sums.count(2), sums.count(1), sums.count(0))
        out[key] = out.get(key, 0) + 1
    return out


def transitivity(a):
    paths = closed = 0
    for i, j, k in itertools.permutations(range(len(a)), 3):
        if a[i, j] and a[j, k]:
            paths += 1
            closed += a[i, k] != 0
    return (closed / paths if paths else 1.0), closed


def profile(a, i, j):
    keep = [k for k in range(len(a)) if k not in (i, j)]
    return np.concatenate([a[i, keep], a[keep, i]]), np.concatenate([a[j, keep], a[keep, j]])


def reach(a):
    return np.isfinite(bfs(a)[0])


def strong(a):
    r = reach(a)
    return [min(np.flatnonzero(r[v] & r[:, v])) for v in range(len(a))]


def weak(a):
    return strong(a + a.T)


def cores(a):
    left, core, level = set(range(len(a))), {}, 0
    while left:
        deg = {v: sum(a[v, u] + a[u, v] for u in left if u != v) for v in left}
        v = min(left, key=lambda x: (deg[x], x))
        level = max(level, deg[v])
        core[v] = level
        left.discard(v)
    return [core[v] for v in range(len(a))]


def open_paths(a, cl):
    out = np.zeros((len(a), 6), int)
    for i, j, k in itertools.permutations(range(len(a)), 3):
        if a[i, j] and a[j, k] and not a[i, k]:
            same = (cl[i] == cl[j], cl[j] == cl[k], cl[i] == cl[k])
            role = 0 if all(same) else 2 if same[0] else 3 if same[1] else 1 if same[2] else 4
            out[j, role] += 1
            out[j, 5] += 1
    return out


def flow(c, s, t):
    c, total = c.copy(), 0.0
    while True:
        up, front = {s: None}, [s]
        while front and t not in up:
            u = front.pop(0)
            for v in np.flatnonzero(c[u] > 0):
                if v not in up:
                    up[v] = u
                    front.append(v)
        if t not in up:
            return total
        path, v = [], t
        while up[v] is not None:
            path.append((up[v], v))
            v = up[v]
        room = min(c[e] for e in path)
        for u, v in path:
            c[u, v] -= room
            c[v, u] += room
        total += room
