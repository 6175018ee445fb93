"""Plain definitions that the operators are compared with."""

import collections
import itertools
import math
import re

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def components(sets, percent):
    """sets: {key: set}; the smallest reachable key of each, by comparing all pairs that share a member."""
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    root = {k: k for k in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in {p for ks in holders.values() for p in itertools.combinations(sorted(ks), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def line_dedup(rows, size=8, percent=80):
    """rows: (doc_id, text) with texts; the texts that stay."""
    lines = [(i, k, x.translate(LOWER).strip()) for i, t in rows for k, x in enumerate(t.split("\n"))]
    nodes = {}
    for _, _, x in lines:
        if x:
            nodes.setdefault(x, len(nodes))
    grams = lambda x: {x} if len(x) < size else {x[i : i + size] for i in range(len(x) - size + 1)}
    group = components({n: frozenset(grams(x)) for x, n in nodes.items()}, percent)
    first, gone = {}, set()
    for i, k, x in sorted(lines, key=lambda r: r[:2]):
        if x and first.setdefault(group[nodes[x]], (i, k)) != (i, k):
            gone.add((i, k))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def kneser_ney(train):
    """train: token lists; (probability of word after context, counts)."""
    c1 = collections.Counter(w for t in train for w in t)
    c2 = collections.Counter(p for t in train for p in zip(["<s>"] + t, t, strict=False))
    total, kinds, seen = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (h, w), c in c2.items():
        total[h] += c
        kinds[h][min(c, 3) - 1] += 1
        seen[w] += 1

    def discounts(values):
        n = [sum(v == j for v in values) for j in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0, 0.5, 0.5, 0.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) for j in (1, 2, 3))]

    d2, d1 = discounts(c2.values()), discounts(seen.values())
    left = sum(d1[min(a, 3)] for a in seen.values()) / max(len(c2), 1) if c2 else 1

    def low(w):
        return (max(seen[w] - d1[min(seen[w], 3)], 0) / len(c2) if c2 else 0) + left / (len(c1) + 1)

    def p(h, w):
        if h not in total:
            return low(w)
        c = c2[h, w]
        return (max(c - d2[min(c, 3)], 0) + sum(d2[j + 1] * kinds[h][j] for j in range(3)) * low(w)) / total[h]

    return p, c1


def log10_sum(p, tokens):
    return sum(math.log10(p(h, w)) for h, w in zip(["<s>"] + tokens, tokens, strict=False))


def windows(rows, items, size=10):
    """rows, items: {key: text}; {key: (words, hit words, sorted item names)}."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    found = collections.defaultdict(set)
    for k, t in items.items():
        w = split(t)
        for i in range(max(len(w) - size + 1, 1 if w else 0)):
            found[tuple(w[i : i + size])].add(str(k))
    sizes = {len(g) for g in found}
    out = {}
    for k, t in rows.items():
        w, hit, names = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in found:
                    hit |= set(range(i, i + n))
                    names |= found[g]
        out[k] = (len(w), len(hit), sorted(names))
    return out
