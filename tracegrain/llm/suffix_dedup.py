"""Repeated-passage removal over a whole corpus with a suffix array, a Burrows-Wheeler transform and
threshold-bounded interval expansion.

Every byte that a ``window``-byte string covers is removed if that string starts earlier too (in a smaller
document id, or earlier in the same document). Equal strings have to meet in one task, so the corpus is dealt out first:

1. ``_runs`` cuts each text into runs of neighbouring windows that share their rarest-ranked k-gram (minimizer).
   Equal windows have equal minimizers. Runs that a block of rows has seen before are settled on the spot, so that
   a passage with millions of copies leaves each block once.
2. The runs' fingerprints are shuffled by minimizer. Equal runs collapse to their earliest copy. A minimizer that has
   different runs needs its text.
3. The text of those runs is gathered and dealt out by minimizer, and ``Transform`` finds, in each bucket,
   all windows that start earlier elsewhere. A minimizer with very many different runs (the edge of a passage that stands in
   countless contexts) is dealt out further: its windows by how far before the minimizer they start, in powers of two, and
   by the bytes that all windows of such a class have in common. A minimizer with more runs than a task should hold
   (any boilerplate line, however long its common part) has each of its windows met by itself, by the whole window's
   fingerprint; no text moves for those, and equal windows collapse to their earliest copy in each batch. Its runs
   are dealt out by run, not by minimizer, from the start.
4. The removed spans of a document are merged and its remaining bytes put together.

What collapses by fingerprint (copies of whole runs, and windows of the hottest minimizers) never comes to a transform: that is the
aggregation before the shuffle, without which a passage's copies would all meet in one block.

Nulls count as empty texts; texts below ``window`` bytes have no window and stay whole; very long texts are read whole, in overlapping
pieces. Of equal strings the earliest stays: smallest doc_id, then smallest ``tie``, then earliest start. A row is known by doc_id and
text (``doc`` and ``tie``, a hash of its text): rows that share an id or have none are documents of their own, in the order of
``tie``, those without an id after all others; rows that repeat id and text are one document and lose nothing to each other,
whatever is removed is removed from each of them. An empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrain.llm.shared import BYTE, U, materialise, mix, partitions, powers, ranges, ship_code, utf8

GRAM = 32
_PIECE = 1 << 20
_PART = U(_PIECE * 2 - 1)
_SEP = 0xFF  # never occurs in UTF-8


class Transform:
    """Suffix order of a block, its Burrows-Wheeler transform and its common prefixes.

    The order is that of longer prefixes than ``depth`` (the next doubling beyond it), so it doesn't say itself which neighbours agree in ``depth`` bytes.

    ``expand`` derives which neighbours in suffix order share fewer than ``depth`` bytes: it starts with the intervals
    of all strings of eight bytes and extends them to the left, one byte a round, breadth first. The interval of cw is
    [C(c) + rank(c, lb), C(c) + rank(c, rb)), and its right end is a boundary of common prefix |w|, unless
    an earlier round has met it. Thus prefix lengths come out by increasing value, and the search stops at ``depth``.
    """

    SEED = 8

    def __init__(self, text: np.ndarray, depth: int):
        if depth < self.SEED:
            raise ValueError(f"a repeated string must have {self.SEED} bytes or more")
        if not len(text) or text[-1] != _SEP:
            raise ValueError("a block ends with a separator, so that it has each byte as often as its transform")
        self.text, self.depth, n = text, depth, len(text)
        padded = np.concatenate([text, np.full(self.SEED, _SEP, np.uint8)])
        packed = np.zeros(n, U)
        for i in range(self.SEED):
            packed = (packed << U(8)) | padded[i : i + n]
        self.seed = rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
        known = self.SEED
        while known < depth:
            after = np.full(n, -1, np.int64)
            after[: max(n - known, 0)] = rank[known:]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            known *= 2
        self.order = np.argsort(rank, kind="stable")
        self.bwt = text[self.order - 1]
        self.bwt[self.order == 0] = _SEP
        by_char = np.argsort(self.bwt, kind="stable")
        self.back = np.empty(n, np.int64)
        self.back[by_char] = np.arange(n)
        same = self.bwt[by_char[1:]] == self.bwt[by_char[:-1]]
        self.next, self.prev = np.full(n, n, np.int64), np.full(n, -1, np.int64)
        self.next[by_char[:-1][same]] = by_char[1:][same]
        self.prev[by_char[1:][same]] = by_char[:-1][same]

    def expand(self) -> np.ndarray:
        """For each place in suffix order whether its prefix of ``depth`` bytes differs from its predecessor's."""
        n = len(self.text)
        seed = self.seed[self.order]
        met = np.zeros(n + 1, bool)
        met[:n][np.concatenate([[True], seed[1:] != seed[:-1]])] = True
        met[n] = True
        lb = np.flatnonzero(met[:n])
        rb = np.append(lb[1:], n)
        for _ in range(self.SEED, self.depth):
            sizes = rb - lb
            at = ranges(lb, sizes)
            at_lb, at_rb = np.repeat(lb, sizes), np.repeat(rb, sizes)
            keep = self.bwt[at] != _SEP
            last = at[keep & (self.next[at] >= at_rb)]
            first = at[keep & (self.prev[at] < at_lb)]
            new_rb = np.sort(self.back[last]) + 1
            new_lb = np.sort(self.back[first])
            new = ~met[new_rb]
            lb, rb = new_lb[new], new_rb[new]
            if not len(rb):
                break
            met[rb] = True
        return met[:n]


def _pieces(at: np.ndarray, window: int):
    """Rows and bounds of stretches of text of at most _PIECE bytes that hold every window once."""
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        s = a
        while b - s >= window:
            e = min(b, s + _PIECE - window)
            yield i, s - a, s, e
            s = e - window + 1
            if e == b:
                break


def _runs(raw: np.ndarray, at: np.ndarray, window: int) -> list[np.ndarray]:
    """Row, start, windows, minimizer, fingerprint and distance to the minimizer of each run of windows that share it."""
    found: list[list[np.ndarray]] = []
    block: list[tuple[int, int, int, int]] = []
    size = 0

    def flush():
        row = np.array([x[0] for x in block])
        base = np.array([x[1] for x in block])
        lens = np.array([x[3] - x[2] for x in block])
        text = np.concatenate([raw[x[2] : x[3]] for x in block])
        ends = np.cumsum(lens)
        found.append(_block_runs(text, row, base, ends - lens, lens, window))

    for p in _pieces(at, window):
        if block and size + p[3] - p[2] > _PIECE:
            flush()
            block, size = [], 0
        block.append(p)
        size += p[3] - p[2]
    if block:
        flush()
    if not found:
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64)]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _block_runs(text, row, base, begin, lens, window):
    n, gram = len(text), min(GRAM, window)
    up, down = powers(_PIECE * 2)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE[text] * up[:n], out=total[1:])
    m = n - gram + 1
    h = mix((total[gram:] - total[:m]) * down[:m])
    low = (h & ~_PART) | np.arange(m, dtype=U)
    span, have = window - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    count = lens - window + 1
    starts = ranges(begin, count)
    piece = np.repeat(np.arange(len(lens)), count)
    anchor = (low[starts] & _PART).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    k = np.flatnonzero(fresh)
    size = np.diff(np.append(k, len(starts)))
    s, p = starts[k], piece[k]
    print_ = mix((total[s + size + window - 1] - total[s]) * down[s] + size.astype(U))
    return row[p], base[p] + s - begin[p], size, h[anchor[k]], print_, anchor[k] - s


def _later(fresh, doc, tie, start):
    """Which rows of sorted groups (``fresh`` where one begins) lie at another place than the first of their group."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    return (doc != doc[first]) | (tie != tie[first]) | (start != start[first])


def _settle(mini, mark, doc, tie, start):
    """The order by minimizer, fingerprint and place, which rows in it begin a minimizer and a run, and the rows (not
    in this order) whose run starts earlier elsewhere."""
    order = np.lexsort((start, tie, doc, mark, mini))
    m, f = mini[order], mark[order]
    new_mini = np.ones(len(order), bool)
    new_mini[1:] = m[1:] != m[:-1]
    new_run = new_mini.copy()
    new_run[1:] |= f[1:] != f[:-1]
    return order, new_mini, new_run, order[_later(new_run, doc[order], tie[order], start[order])]


def _merged(doc, tie, start, end):
    """Union of the spans of each document."""
    if not len(doc):
        return doc, tie, start, end
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    other = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    group = np.concatenate([[0], np.cumsum(other)])
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = other | (start[1:] + lift[1:] > reach[:-1])
    k = np.flatnonzero(fresh)
    return doc[k], tie[k], start[k], (reach - lift)[np.append(k[1:], len(doc)) - 1]


_SPANS = "doc long, tie long, start long, stop long, mini long, lead int, kind int, bucket int, payload binary"
_ROW = [("mini", np.uint64), ("mark", np.uint64), ("doc", np.int64), ("tie", np.int64), ("start", np.uint32), ("size", np.int16), ("lead", np.int16)]


def _pack(*cols) -> bytes:
    return b"".join(np.ascontiguousarray(c, t).tobytes() for c, (_, t) in zip(cols, _ROW, strict=True))


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, out, at = len(raw) // sum(np.dtype(t).itemsize for _, t in _ROW), [], 0
    for _, t in _ROW:
        col = np.frombuffer(raw, t, n, at)
        out.append(col if t in (np.uint64, np.int64) else col.astype(np.int64))
        at += n * np.dtype(t).itemsize
    return out


def _table(kind, doc=(), tie=(), start=(), stop=(), mini=(), lead=(), bucket=(), payload=None) -> pa.RecordBatch:
    n = len(bucket) if payload is not None else len(doc)
    col = lambda x, t: pa.array(np.asarray(x, t) if len(x) else np.zeros(n, t))
    return pa.RecordBatch.from_arrays(
        [col(doc, np.int64), col(tie, np.int64), col(start, np.int64), col(stop, np.int64), col(np.asarray(mini, U).view(np.int64), np.int64), col(lead, np.int32), col(np.broadcast_to(kind, n), np.int32), col(bucket, np.int32), pa.array(payload if payload is not None else [None] * n, pa.binary())],
        names=["doc", "tie", "start", "stop", "mini", "lead", "kind", "bucket", "payload"],
    )


#: Runs that a task holds before it settles them.
_HOLD = 1_000_000


def _cut(window: int, buckets: int):
    def run(batches):
        held, n = [], 0

        def settle():
            row, tie, start, size, mini, mark, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            order, _, new_run, again = _settle(mini, mark, row, tie, start)
            if len(again):
                yield _table(0, *_merged(row[again], tie[again], start[again], start[again] + size[again] + window - 1))
            first = np.sort(order[new_run])
            mini, mark, row, tie, start, size, lead = (x[first] for x in (mini, mark, row, tie, start, size, lead))
            # A minimizer that is hot in this block: its runs go where their fingerprints say, and word of it to its own bucket.
            names, group, many = np.unique(mini, return_inverse=True, return_counts=True)
            hot = (many > SPREAD)[group]
            known = names[many > SPREAD]
            bucket = (mix(np.where(hot, mix(mini) ^ mark, mini)) % U(buckets)).astype(np.int32)
            lead = np.where(hot, -1 - lead, lead)
            if len(known):
                word = np.zeros(len(known), np.int64)
                bucket = np.concatenate([bucket, (mix(known) % U(buckets)).astype(np.int32)])
                mini, mark = np.concatenate([mini, known]), np.concatenate([mark, word.astype(U)])
                row, tie, start, size, lead = (np.concatenate([x, word]) for x in (row, tie, start, size, lead))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            live = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            for i in range(0, len(live), 64):
                some = live[i : i + 64]
                parts = [order[cuts[b] : cuts[b + 1]] for b in some]
                yield _table(1, bucket=some, payload=[_pack(mini[p], mark[p], row[p], tie[p], start[p], size[p], lead[p]) for p in parts])

        for batch in batches:
            raw, at = utf8(batch.column("text"))
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            row, start, size, mini, mark, lead = _runs(raw, at, window)
            held.append((ids[row], ties[row], start, size, mini, mark, lead))
            n += len(row)
            if n >= _HOLD:
                yield from settle()
                held, n = [], 0
        if n:
            yield from settle()

    return run


#: A minimizer with more different runs is dealt out by class, beyond MOST window by window. All of a group's text stands
#: in one block, so that MOST bounds it. A minimizer with more than SPREAD different runs among those that a task holds at once
#: is dealt out window by window at once, so that no task has to read all its runs.
MANY, MOST, SPREAD = 256, 4096, 512


def _meet(window: int):
    def run(batches):
        held, spans = [], []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 0).any():
                spans.append(batch.filter(pa.array(kind == 0)))
            held += [_unpack(x) for x in batch.column("payload").to_pylist() if x]
        yield from spans
        if not held:
            return
        mini, mark, doc, tie, start, size, lead = (np.concatenate(x) for x in zip(*held, strict=True))
        word, spread = size == 0, lead < 0
        known = np.unique(mini[word | spread])
        lead = np.where(spread, -1 - lead, lead)
        mini, mark, doc, tie, start, size, lead = (x[~word] for x in (mini, mark, doc, tie, start, size, lead))
        if not len(mini):
            return
        order, new_mini, new_run, again = _settle(mini, mark, doc, tie, start)
        yield _table(0, *_merged(doc[again], tie[again], start[again], start[again] + size[again] + window - 1))
        hot = np.isin(mini[order], known)
        group = np.cumsum(new_mini) - 1
        different = np.bincount(group, weights=new_run)[group]
        want = new_run & ((different > 1) | hot)
        ask = order[want]
        yield _table(np.where(hot[want] | (different[want] > MOST), 4, np.where(different[want] > MANY, 3, 2)), doc[ask], tie[ask], start[ask], start[ask] + size[ask] + window - 1, mini[ask], lead[ask])

    return run


def _classes(raw, at, row, start, stop, mini, lead, window):
    """Stretches of runs whose windows start 0, 1, 2 to 3, 4 to 7, ... bytes before the minimizer, each with a key of its own.

    All windows of a class hold the bytes from the nearest start to the farthest end, so equal windows have equal keys."""
    import xxhash

    out = []
    last = lead - (stop - start - window)  # distance of the last window
    for c in range(int(lead.max(initial=0)).bit_length() + 1):
        near, far = (0, 0) if c == 0 else (1 << (c - 1), min((1 << c) - 1, window - min(GRAM, window)))
        lo, hi = np.maximum(last, near), np.minimum(lead, far)
        i = np.flatnonzero(lo <= hi)
        mark = start[i] + lead[i]
        begin, end = at[row[i]] + mark - near, at[row[i]] + mark - far + window
        key = np.array([xxhash.xxh3_64_intdigest(raw[a:b].tobytes(), c) for a, b in zip(begin, end, strict=True)], U)
        out.append((row[i], mark - hi[i], mark - lo[i] + window, mix(key ^ mini[i].view(U))))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _windows(raw, at, row, start, stop, mini, lead, window):
    """Each window of these runs as a run of its own: row, start, minimizer with distance, fingerprint. In parts of bounded size."""
    up, down = powers(_PIECE * 2)
    sizes = stop - start
    total, i = np.cumsum(sizes), 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PIECE, "right")))
        n = sizes[i:j]
        text = raw[ranges(at[row[i:j]] + start[i:j], n)]
        sums = np.zeros(len(text) + 1, U)
        np.cumsum(BYTE[text] * up[: len(text)], out=sums[1:])
        count = n - window + 1
        s = ranges(np.cumsum(n) - n, count)
        step = ranges(np.zeros(j - i, np.int64), count)
        of = np.repeat(np.arange(i, j), count)
        distance = (lead[of] - step).astype(U)
        yield row[of], start[of] + step, mix(mini[of] + distance), mix((sums[s + window] - sums[s]) * down[s] + U(window))
        i = j


def _by_bucket(bucket, buckets, *cols):
    """Buckets that have rows, and the rows of each, packed."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    live = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return live, [_pack(*(c[order[cuts[b] : cuts[b + 1]]] for c in cols)) for b in live]


_SEGS = "bucket int, mini long, doc long, tie long, start long, stop long, seg binary"


def _segs(bucket, mini, doc, tie, start, stop, seg) -> pa.RecordBatch:
    cols = [pa.array(x) for x in (bucket, mini.view(np.int64), doc, tie, start, stop)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(seg, pa.binary())], names=["bucket", "mini", "doc", "tie", "start", "stop", "seg"])


def _fetch(window: int, buckets: int):
    def run(batches):
        last = None
        for batch in batches:
            # Rows that repeat id and text stand side by side after the join; one of them will do.
            places = list(zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), strict=True))
            other = [a != b for a, b in zip(places, [last, *places], strict=False)]
            last = places[-1] if places else last
            if not all(other):
                batch = batch.filter(pa.array(other))
            if not batch.num_rows:
                continue
            raw, at = utf8(batch.column("text"))
            asked = batch.column("asked")
            begins = asked.offsets.to_numpy()
            flat = asked.values
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            start, stop, mini, lead, kind = (flat.field(i).to_numpy(zero_copy_only=False)[begins[0] : begins[-1]] for i in range(5))
            mini = mini.view(U)
            single = kind == 4
            if single.any():
                for r, s, key, mark in _windows(raw, at, *(x[single] for x in (row, start, stop, mini, lead.astype(np.int64))), window):
                    doc, tie = ids[r], ties[r]
                    order, _, new, again = _settle(key, mark, doc, tie, s)
                    d, t, a, b = _merged(doc[again], tie[again], s[again], s[again] + window)
                    yield _segs(np.zeros(len(d), np.int32), np.zeros(len(d), U), d, t, a, b, [None] * len(d))
                    first = order[new]
                    one = np.ones(len(first), np.int32)
                    live, packed = _by_bucket((mix(key[first] ^ mark[first]) % U(buckets)).astype(np.int32), buckets, key[first], mark[first], doc[first], tie[first], s[first], one, 0 * one)
                    none = np.zeros(len(live), np.int64)
                    # Where a row begins before its text does, it is a bucket of windows.
                    yield _segs(np.array(live, np.int32), none.view(U), none, none, none - 1, none, packed)
                row, start, stop, mini, lead, kind = (x[~single] for x in (row, start, stop, mini, lead, kind))
            hot = kind == 3
            if hot.any():
                more = _classes(raw, at, row[hot], start[hot], stop[hot], mini[hot], lead[hot].astype(np.int64), window)
                row, start, stop, mini = (np.concatenate([x[~hot], y]) for x, y in zip((row, start, stop, mini), more, strict=True))
            hot = np.arange(len(row)) >= (~hot).sum()
            bucket = (mix(mini) % U(buckets)).astype(np.int32)
            text = [raw[a:b].tobytes() for a, b in zip(at[row] + start, at[row] + stop, strict=True)]
            if hot.any():
                seen = {}
                for i in sorted(np.flatnonzero(hot).tolist(), key=lambda i: (ids[row[i]], ties[row[i]], start[i])):
                    if seen.setdefault((mini[i], text[i]), i) != i:
                        text[i] = None
            yield _segs(bucket, mini, ids[row], ties[row], start, stop, text)

    return run


def _search(window: int, most: int = 1 << 20):
    def block(doc, tie, start, raw, at):
        lens = np.diff(at)
        text = np.full(len(raw) + len(lens), _SEP, np.uint8)
        begin = at[:-1] + np.arange(len(lens))
        text[ranges(begin, lens)] = raw
        index = Transform(text, window)
        differs = index.expand()
        is_start = np.zeros(len(text), bool)
        count = lens - window + 1
        opens = ranges(begin, count)
        is_start[opens] = True
        owner = np.zeros(len(text), np.int64)
        owner[opens] = np.repeat(np.arange(len(lens)), count)
        group = np.cumsum(differs) - 1
        use = is_start[index.order]
        pos, group = index.order[use], group[use]
        seg = owner[pos]
        place = start[seg] + pos - begin[seg]
        by = np.lexsort((place, tie[seg], doc[seg], group))
        g = group[by]
        fresh = np.ones(len(g), bool)
        fresh[1:] = g[1:] != g[:-1]
        again = by[_later(fresh, doc[seg[by]], tie[seg[by]], place[by])]
        return doc[seg[again]], tie[seg[again]], place[again], place[again] + window

    def run(batches):
        parts, single = [], []
        for batch in batches:
            packed = batch.column("start").to_numpy() < 0
            if packed.any():
                single += [_unpack(x) for x in batch.column("seg").filter(pa.array(packed)).to_pylist()]
                batch = batch.filter(pa.array(~packed))
            parts.append(batch)
        if single:
            mini, mark, doc, tie, start, _, _ = (np.concatenate(x) for x in zip(*single, strict=True))
            again = _settle(mini, mark, doc, tie, start)[3]
            yield _table(0, *_merged(doc[again], tie[again], start[again], start[again] + window))
            del single, mini, mark, doc, tie, start, again
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        known = table.filter(table.column("seg").is_null())
        yield _table(0, *(known.column(c).to_numpy() for c in ("doc", "tie", "start", "stop")))
        table = table.filter(table.column("seg").is_valid()).sort_by("mini").combine_chunks()
        mini = table.column("mini").to_numpy()
        same = mini[1:] == mini[:-1]
        table = table.filter(pa.array(np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(mini) else np.zeros(0, bool))).combine_chunks()
        if not table.num_rows:
            return
        mini = table.column("mini").to_numpy()
        doc, tie, start = (table.column(c).to_numpy() for c in ("doc", "tie", "start"))
        seg = table.column("seg").combine_chunks() if table.column("seg").num_chunks != 1 else table.column("seg").chunk(0)
        seg = seg.cast(pa.large_binary())
        at = np.frombuffer(seg.buffers()[1], np.int64)[seg.offset : seg.offset + len(seg) + 1]
        raw = np.frombuffer(seg.buffers()[2], np.uint8)
        edges = np.append(np.flatnonzero(np.concatenate([[True], mini[1:] != mini[:-1]])), len(mini))
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(at[edges], at[edges[i]] + most, "right")) - 1)
            a, b = edges[i], edges[j]
            yield _table(0, *_merged(*block(doc[a:b], tie[a:b], start[a:b], raw[at[a] : at[b]], at[a : b + 1] - at[a])))
            i = j

    return run


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """Rows with what they are known by: id (the largest number if there is none) and a hash of the text."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tie"), *more)


def repeated_spans(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc, tie, spans array<struct<start, stop>>): byte spans, not yet merged, of what starts earlier elsewhere."""
    if window > 1 << 14:
        raise ValueError(f"a window has at most {1 << 14} bytes")
    spark = docs.sparkSession
    ship_code(spark)
    src = _keyed(docs).drop("doc_id")
    n = partitions(spark, src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0])
    own = F.xxhash64("doc", "tie")
    cut = src.mapInArrow(_cut(window, 4 * n), _SPANS)
    # Spans that are settled already are spread by document, payloads by bucket.
    dealt = cut.repartition(n, F.when(F.col("kind") == 1, F.col("bucket").cast("long")).otherwise(own))
    met = materialise(dealt.mapInArrow(_meet(window), _SPANS).select("doc", "tie", "start", "stop", "mini", "lead", "kind"), "suffix-runs")
    asked = met.where("kind > 1").groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop", "mini", "lead", "kind")).alias("asked"))
    segs = src.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked").mapInArrow(_fetch(window, 4 * n), _SEGS)
    found = segs.repartition(n, F.when(F.col("seg").isNotNull(), F.col("bucket").cast("long")).otherwise(own)).mapInArrow(_search(window), _SPANS).select("doc", "tie", "start", "stop")
    spans = met.where("kind = 0").select("doc", "tie", "start", "stop").unionByName(found)
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _strip(keep_text: bool, carry: bool):
    """Merge the spans of each row, count what they cover and put the rest together."""

    def run(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            n_removed, n_spans, digests, texts = [], [], [], []
            for i, own in enumerate(spans):
                text = raw[at[i] : at[i + 1]].tobytes()
                gone = runs = 0
                if own:
                    parts, end = [], 0
                    for s, e in sorted((x["start"], x["stop"]) for x in own):
                        if s > end or not runs:
                            runs += 1
                            parts.append(text[end:s])
                            gone += e - s
                            end = e
                        elif e > end:
                            gone += e - end
                            end = e
                    parts.append(text[end:])
                    text = b"".join(parts)
                n_removed.append(gone)
                n_spans.append(runs)
                digests.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    texts.append(text.decode("utf-8", "ignore"))
            out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if keep_text:
                out["text"] = pa.array(texts, pa.string())
            if carry:
                out["carried"] = batch.column("carried")
            yield pa.RecordBatch.from_pydict(out)

    return run


def suffix_array_dedup(docs: DataFrame, window: int = 100, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, with ``keep_text`` the remaining text (bytes of characters cut in two are left out of it), and the
    figures n_bytes, n_removed, n_spans, kept_sha256 of each row; the columns ``carry`` come along as they are."""
    spans = repeated_spans(docs, window)
    rows = _keyed(docs, F.struct(*carry).alias("carried")) if carry else _keyed(docs)
    joined = rows.join(spans, ["doc", "tie"], "left").drop("doc", "tie")
    out = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text)
    if not carry:
        return joined.mapInArrow(_strip(keep_text, False), out)
    names = out.fieldNames()
    return joined.mapInArrow(_strip(keep_text, True), out.add(rows.schema["carried"])).select(*names, "carried.*")
