"""The operators' results in plain Python."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def shingles(text, width):
    w = TOKEN.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_components(pairs, width, percent):
    """(doc_id -> set size, component) of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t, width) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_root, b_root = sorted((root(a), root(b)))
                parent[b_root] = a_root
    return {i: (len(sets[i]), root(i)) for i in ids}


def contamination(pairs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = {}
    for i, text in pairs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit |= set(range(k, k + n))
                    found |= owners
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out
