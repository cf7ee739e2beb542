"""Plain re-statements of what the operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict


def suffix(docs, window=100):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_rules(text):
    w = SPACE.findall(text or "")
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    hit = {i + k for x in tri.values() if len(x) > 1 for i in x for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def compression(text, lim):
    """kept, number of chunks, chunks beyond their limits."""
    import zstandard

    raw, z = (text or "").encode(), zstandard.ZstdCompressor(level=lim.level, write_checksum=False)
    ratio = lambda x: len(x) / len(z.compress(x)) if x else 0.0
    starts = [*range(0, len(raw) - lim.chunk, lim.chunk), len(raw) - lim.chunk] if len(raw) >= lim.chunk else []
    odd = sum(not lim.chunk_least <= ratio(raw[i : i + lim.chunk]) <= lim.chunk_most for i in starts)
    least, most = next((lo, hi) for top, lo, hi in lim.bands if len(raw) <= top)
    return not base_rules(text)[5] and least <= ratio(raw) <= most and odd <= lim.chunk_share * len(starts), len(starts), odd


def contamination(docs, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(fold(text))
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            wins[tuple(w[i : i + size])].add(str(item))
    sizes = sorted({len(x) for x in wins})
    out = {}
    for doc, text in docs:
        w = PLAIN.findall(fold(text))
        hit, found = set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if own := wins.get(tuple(w[i : i + s])):
                    hit.update(range(i, i + s))
                    found |= own
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def shingle_set(text, n=5):
    w = SPACE.findall(fold(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def near(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shared = defaultdict(int)
    for own in by.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def encode(path, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [x.ids + [end] for x in t.encode_batch([y or "" for y in text], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs):
    n = defaultdict(int)
    for doc, text in docs:
        for w in RUNS.findall(fold(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}


def variants(n):
    """By comparing each two words."""
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, top=10):
    """(item, [(doc, score)]): by scoring each document for each item."""
    import math
    from collections import Counter

    own = [(d, Counter(TERMS.findall(fold(t)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        wanted, found = Counter(TERMS.findall(fold(text))), []
        for d, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if score > 0:
                found.append((d, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out.append((item, found[:top]))
    return out
