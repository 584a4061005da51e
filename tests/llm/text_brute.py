"""Plain versions of the text operators."""

import re
from collections import defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def jaccard_components(rows, percent=80):
    sets = {i: shingle_set(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    links = []
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    shared[j] += 1
        links += [(i, j) for j, c in shared.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    low = components(sets, links)
    return {i: (len(s), low[i]) for i, s in sets.items()}
