"""Plain-Python versions that the operators are held against."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BLANK.split((text or "").encode("utf-8", "surrogatepass")) if w]


def shingles(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows):
    """rows (doc_id, text) to sorted rows of doc_id, n_shingles, component_id, kept."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in index.values() if len(ks) < 400 for a in ks for b in ks if a < b}
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        if i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
            u, v = find(i), find(j)
            root[max(u, v)] = min(u, v)
    out = []
    for i, s in sets:
        c = None if i is None else find(i)
        out.append((i, len(s), c, True if i is None else i == c))
    return sorted(out, key=str)


def removals(rows, width=200):
    """rows (doc_id, text) to sorted rows of doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + width] for _, r in raws for k in range(len(r) - width + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\x01" * width
        spans = len([1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1])])
        left = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    return len(w), sum(len(x.decode("utf-8", "surrogatepass")) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def window_removals(rows, width=13):
    """rows (doc_id, text) to sorted rows of doc_id, n_words, n_removed, kept_sha256."""
    split = [(i, words(t)) for i, t in rows]
    low = {}
    for i, w in split:
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, w in split:
        gone = bytearray(len(w))
        for k in range(len(w) - width + 1):
            if i is not None and low[tuple(w[k : k + width])] < i:
                gone[k : k + width] = b"\x01" * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def whole(vector):
    """floor(256 * x) of a vector's components, or None where it takes no part."""
    if vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
        return None
    return [int((256 * x) // 1) for x in vector]


def codes(rows, parts=16, entries=64, rounds=2):
    """rows (vec_id, label, vector) to sorted rows of vec_id, code, error, label_error, codebooks_sha256."""
    kept = [(i, lab, whole(v)) for i, lab, v in rows if whole(v) is not None]
    if not kept:
        return []
    d = len(kept[0][2]) // parts
    cut = [(i, lab, [w[p * d : p * d + d] for p in range(parts)]) for i, lab, w in kept]
    first = {}
    for i, _, w in sorted((r for r in cut if r[0] is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, w)
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, _, w in cut:
            for p in range(parts):
                held[p][nearest(p, w[p])].append(w[p])
        books = [[[sum(c) // len(c) for c in zip(*vs)] if vs else books[p][e] for e, vs in enumerate(held[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], Counter()
    for i, lab, w in cut:
        code = [nearest(p, w[p]) for p in range(parts)]
        error = sum(far(w[p], books[p][e]) for p, e in enumerate(code))
        by[lab] += error
        out.append((i, lab, "".join(f"{e:02x}" for e in code), error))
    return sorted(((i, code, error, by[lab], sha) for i, lab, code, error in out), key=str)


def negatives(rows):
    """rows (vec_id, label, vector), one an id, to sorted rows of anchor, positive, rank, negative and both scores."""
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, whole(v)) for i, lab, v in rows if None not in (i, lab) and whole(v) is not None]
    out = []
    for i, lab, w in kept:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(w, v)), j, other == lab) for j, other, v in kept if j != i)
        for s, j, _ in [r for r in scored if r[2]][:5]:
            found = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)]
    return sorted(out)
