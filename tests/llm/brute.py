"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def components(nodes, linked):
    """Smallest reachable node of each node; ``linked(a, b)`` tells links."""
    left, out = set(nodes), {}
    while left:
        start = min(left)
        group, todo = {start}, [start]
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in group and linked(a, b):
                    group.add(b)
                    todo.append(b)
        out |= dict.fromkeys(group, start)
        left -= group
    return out


def simhash(text, width=4):
    tokens = words(text)
    shingles = [" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def overlap(text, item, window=20, share=0.8, least=8):
    """Most equal tokens of an aligned window, which the text's edges may clip, or None."""
    token = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
    t, i = token.findall(low(text)), token.findall(low(item))
    size = min(window, len(i))
    if len(i) < 3:
        return None
    best = -1
    for shift in range(1 - len(i), len(t)):
        begin, end = max(0, -shift), min(len(i), len(t) - shift)
        for start in range(len(i) - size + 1):
            a, b = max(start, begin), min(start + size, end)
            if b - a >= min(size, least):
                same = sum(x == y for x, y in zip(i[a:b], t[a + shift : b + shift], strict=True))
                if same >= math.ceil((share if size >= least else 1) * (b - a)):
                    best = max(best, same)
    return best if best > 0 else None


def cosine_links(vectors, least=0.95):
    """Per row the number of linked rows, and the smallest linked id reachable."""
    good = {}
    for key, v in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            a /= np.abs(a).max()
            good[key] = a / np.linalg.norm(a)
    linked = lambda a, b: a in good and b in good and float(good[a] @ good[b]) >= least
    ids = [k for k, _ in vectors]
    label = components(ids, linked)
    return {k: (sum(linked(k, o) for o in ids if o != k), label[k]) for k in ids}


def ppm(train, texts, order=5):
    """log10 probability of each text by a PPM model with method C and exclusion."""
    stream = lambda t: b"\n" * order + " ".join(words(t)).encode() + b"\n"
    tries = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for text in train:
        s = stream(text)
        for i in range(order, len(s)):
            for k in range(order + 1):
                tries[k][s[i - k : i]][s[i]] += 1

    def code(context, symbol):
        excluded, total = set(), 0.0
        for k in range(order, -1, -1):
            seen = {a: n for a, n in tries[k].get(context[order - k :], {}).items() if a not in excluded}
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if symbol in seen:
                return total + math.log10(seen[symbol] / (n + kinds))
            total += math.log10(kinds / (n + kinds))
            excluded |= set(seen)
        return total - math.log10(256 - len(excluded))

    return [sum(code(s[i - order : i], s[i]) for i in range(order, len(s))) for s in map(stream, texts)]


def targets(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Target of each source, by handing out the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        active = [s for s in order if s not in full]
        asked = {s: rest * weight[s] / sum(weight[a] for a in active) for s in active}
        over = {s for s in active if asked[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else asked[s] for s in order}
        full |= over
        if full == set(order):
            return {s: most * sizes[s] for s in order}
