"""Plain-Python counterparts of the operators, for small fixtures."""

import re

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").lower())


def shingles(text, n):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def pairs_at_least(docs, n, threshold):
    """{(a, b): similarity} over all pairs of ids."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b): j for k, a in enumerate(ids) for b in ids[k + 1 :] if (j := jaccard(sets[a], sets[b])) >= threshold}


def groups(ids, pairs):
    """{id: least id of its connected component}."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def containment(doc, item, n):
    w = words(item)
    k = min(len(w), n)
    if not k:
        return 0.0
    want, have = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, words(doc)
    return len(want & {tuple(have[i : i + k]) for i in range(len(have) - k + 1)}) / len(want)
