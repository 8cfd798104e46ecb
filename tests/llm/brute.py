"""Plain Python versions of what operators compute, for small tables."""

import re

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_lines(rows, least=10):
    """(doc_id, text) rows to (doc_id, lines, dropped, kept text); null ids come first."""
    order = lambda d: (d is not None, d)
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(FOLD)
            if len(key) >= least:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line.strip(BLANKS).translate(FOLD), {doc_id})
            if min(ids, key=order) == doc_id:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_components(rows, n=4, percent=85):
    """(doc_id, text) rows to {doc_id: smallest linked doc_id}, by all pairs."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, set()).add(shingles(text, n))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if find(a) != find(b) and any(
                x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y))
                and 100 * len(x & y) >= percent * len(x | y)
                for x in sets[a] for y in sets[b]
            ):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}
