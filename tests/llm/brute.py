"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict
from math import log1p

import numpy as np
import xxhash

BLANKS = r"[^\x20\x09-\x0D]+"


class Union:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def simhash(text):
    words = re.findall(BLANKS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash_classes(docs, radius=2):
    """docs: (id, text); ids unique."""
    marks = {k: simhash(t) for k, t in docs}
    union = Union(marks)
    ids = list(marks)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                union.link(a, b)
    return {k: (f"{marks[k]:016x}", union.root(k)) for k in ids}


def cosine_links(rows, threshold=0.93):
    """rows: (id, vector, label) -> id: (links, component)."""
    union, links = Union([k for k, _, _ in rows]), Counter()
    usable = [(k, np.array(v, dtype=float), c) for k, v, c in rows if c is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float))]
    for i, (a, x, c) in enumerate(usable):
        for b, y, d in usable[i + 1 :]:
            if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                union.link(a, b)
    return {k: (links[k], union.root(k)) for k, _, _ in rows}


def bm25(docs, queries, k):
    """docs, queries: (id, text) -> query id: [(id, score)]."""
    counts = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in docs]
    mean = sum(sum(c.values()) for c in counts) / len(docs)
    df = Counter(t for c in counts for t in c)
    out = defaultdict(list)
    for q, text in queries:
        wanted = Counter(re.findall(r"[^\W_]+", (text or "").lower()))
        for (d, _), c in zip(docs, counts, strict=True):
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            score = sum(n * log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t, n in wanted.items() if c[t])
            if score:
                out[q].append((d, score))
        out[q] = sorted(out[q], key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out
