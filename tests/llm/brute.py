"""Plain re-computations that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lowered)
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows):
    """``{row number: (id, set size, smallest id of the class)}`` of ``(id, text)`` rows."""
    sets = [shingles(t) for _, t in rows]
    groups = Union(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    groups.join(i, j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[groups.find(i)].append(key)
    return [
        (key, len(sets[i]), min(least[groups.find(i)], default=None) if sets[i] else key)
        for i, (key, _) in enumerate(rows)
    ]


def fill_targets(sizes: dict, weights, share: float, limit: int) -> dict:
    """Water filling by repeated resharing; sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=order.index):
            target[s] += unit * weight[s]
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = float(limit * sizes[s])
                open_.discard(s)
    return target
