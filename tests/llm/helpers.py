"""Brute-force versions that several tests compare with."""

import itertools


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_groups(texts):
    """doc_id to least reachable id, by all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}, sets


def line_oracle(texts):
    """(doc_id, line) of each line that is removed to the earlier lines that match it."""
    lines = [(d, i, frozenset(l.split())) for d in sorted(texts) for i, l in enumerate((texts[d] or "").split("\n"))]
    lines = [l for l in lines if l[2]]
    out = {}
    for k, (d, i, s) in enumerate(lines):
        for e, j, t in lines[:k]:
            both = len(s & t)
            if both and 100 * both >= 75 * (len(s) + len(t) - both):
                out.setdefault((d, i), set()).add((e, j))
    return out
