"""Plain versions of the operators' definitions, for small inputs."""
import hashlib
from collections import Counter, defaultdict


#: Empty, null, blank, repeated, tied and very long texts, and rows without an id.
ODD_ROWS = [
    (1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (2, "ALPHA beta gamma"), (3, None), (4, ""), (5, " \t\n"),
    (None, "alpha beta gamma"), (None, None), (6, "word " * 50_000), (7, "word " * 50_000), (8, "x" * 100_000),
    (9007199254740993, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"),
]


def words(text):
    return (text or "").encode().split()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    w = words(fold(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1)))


def jaccard(rows, size, percent):
    """{row number: (set size, smallest id of the component)}; every pair of rows is compared."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(x)].append(i)
    return Counter((i, len(sets[x]), (min(ids[find(x)]) if ids[find(x)] else None) if sets[x] else i)
                   for x, (i, _) in enumerate(rows))


def substring(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                run = tuple(w[k:k + window])
                first[run] = min(i, first.get(run, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)
