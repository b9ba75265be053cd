"""Plain versions of the operators for small inputs."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    words = WORD.findall((text or "").encode().lower())
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def jaccard_groups(docs, num=75, den=100):
    """{id: (set size, smallest id reachable)} of (id, text) rows."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1:]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and passes_luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
)


def passes_luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    return [
        (kind, *m.span())
        for kind, pattern, good in PATTERNS
        for m in re.finditer(pattern, text or "")
        if good(m.group(), re.sub("[^0-9]", "", m.group()))
    ]


def top_products(vectors, k=20, every=20):
    """[(query, rank, id, score)] of {id: components}."""
    import math

    whole = {i: [math.floor(64 * float(c)) for c in v] for i, v in vectors.items()}
    near = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        scores = sorted((-near(sum(a * b for a, b in zip(whole[q], x))), i) for i, x in whole.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out
