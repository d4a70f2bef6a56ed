"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i))
    return {i: (min(groups[bare(t)])[1], len(groups[bare(t)]), hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows}


def shingles(text, size):
    w = words(text, lower=True)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, size):
    """Removed word flags of each document."""
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out[i] = (w, gone)
    return out


def digest(kept):
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def fewest_bins(lengths, capacity):
    best, ordered = [len(lengths)], sorted(lengths, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(ordered):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + ordered[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += ordered[i]
                go(i + 1, bins)
                bins[j] -= ordered[i]
        bins.append(ordered[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]
