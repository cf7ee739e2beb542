"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` words (a shorter item is one window). Each window is a set of word
shingles; a text that holds the window holds all of them, so one necessary shingle, the rarest over the whole corpus, is
enough to find candidates. The shingle's place in the window gives the only start the window can have in the document
(positional bound), the words left there bound its length, and a candidate counts only if all its words are equal, byte for byte.

The items come in blocks of at most ``block_words`` words (a longer item is cut, with no window lost), and each block's windows are sent to all tasks: what is
broadcast is bounded, however large the benchmark. Documents are never shuffled; with several blocks, what was found in them is.

Null texts have no words; items without words have no windows; repeated item rows count once, and equal item_ids are one
item, whatever their texts; each row of the documents has a row of its own in the result, also where rows repeat, share an id or
have none; very long texts are read whole; a window that occurs again counts again; an empty benchmark leaves all documents
clean, and empty documents give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import U, fold, materialise, ranges, shingles, ship_code, slices, utf8, word_hashes, words

SHINGLE = 3
#: Words of benchmark items that one pass looks for.
BLOCK_WORDS = 1_000_000


class Words:
    """The words of texts laid end to end: hashes, how many lie before each text, and their bytes without what stood between."""

    def __init__(self, texts):
        raw, at = utf8(texts)
        raw = fold(raw)
        starts, ends, self.before = words(raw, at, plain=True)
        self.hash = word_hashes(raw, starts, ends)
        self.raw, self.starts, self.size = raw, starts, ends - starts

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.raw[ranges(self.starts, self.size)], np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)


class Windows:
    """The windows of one block of items: word hashes laid end to end, with first word, size and item of each."""

    def __init__(self, items: pd.DataFrame, size: int):
        own = Words(pa.array(items["text"], pa.string()))
        self.hash, before = own.hash, own.before
        self.raw, self.at = own.bytes()
        n = np.diff(before)
        each = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
        self.first = ranges(before[:-1], each)
        self.ids, of = np.unique(np.array([str(x) for x in items["item_id"]], object), return_inverse=True)
        self.item = np.repeat(of.astype(np.int64), each)
        self.size = np.minimum(np.repeat(n, each), size)
        self.wide = sorted({int(min(s, SHINGLE)) for s in self.size})

    def equal(self, docs: Words, start: np.ndarray, wins: np.ndarray) -> np.ndarray:
        """Which of these windows stand at these words of the documents, by length of each word and by bytes."""
        out = np.ones(len(start), bool)
        if not len(start):
            return out
        first, size = self.first[wins], self.size[wins]
        for i in range(int(size.max())):
            here = i < size
            a, b = np.minimum(start + i, len(docs.size) - 1), np.minimum(first + i, len(self.hash) - 1)
            out &= ~here | (docs.size[a] == self.at[b + 1] - self.at[b])
        raw, at = docs.bytes()
        some = np.flatnonzero(out)
        n = self.at[first[some] + size[some]] - self.at[first[some]]
        for i, j in _groups(n, 1 << 24):
            k = some[i:j]
            same = raw[ranges(at[start[k]], n[i:j])] == self.raw[ranges(self.at[first[k]], n[i:j])]
            out[k] = np.logical_and.reduceat(same, np.cumsum(n[i:j]) - n[i:j])
        return out

    def tokens(self, width: int) -> np.ndarray:
        """All distinct shingles of this width, as a sorted array."""
        return np.unique(shingles(self.hash, width))

    def choose(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Take each window's rarest shingle (the first of equals) as its prefix."""
        self.lookup = {}
        for width in self.wide:
            own = np.flatnonzero(np.minimum(self.size, SHINGLE) == width)
            tokens, seen = counts[width]
            g = shingles(self.hash, width)
            rare = seen[np.searchsorted(tokens, g)]
            k = self.size[own] - width + 1
            at = ranges(self.first[own], k)
            win = np.repeat(np.arange(len(own)), k)
            order = np.lexsort((at, rare[at], win))
            best = at[order[np.concatenate([[0], np.cumsum(k)[:-1]])]]
            by = np.argsort(g[best], kind="stable")
            self.lookup[width] = (g[best][by], own[by], (best - self.first[own])[by], _bits(g[best]))


def _bits(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(keys >> U(44)).astype(np.int64)] = True
    return table


def _groups(k: np.ndarray, most: int):
    """Stretches of neighbouring entries whose sum is at most ``most`` (one entry at least)."""
    total, i = np.cumsum(k), 0
    while i < len(k):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _count(win: Windows):
    def run(batches):
        tables = {w: win.tokens(w) for w in win.wide}
        bits = {w: _bits(t) for w, t in tables.items()}
        sums = {w: np.zeros(len(t), np.int64) for w, t in tables.items()}
        for whole in batches:
            for batch in slices(whole):
                own = Words(batch.column("text"))
                h, before = own.hash, own.before
                doc = np.repeat(np.arange(batch.num_rows), np.diff(before))
                for w, t in tables.items():
                    g = shingles(h, w)
                    at = np.flatnonzero(bits[w][(g >> U(44)).astype(np.int64)])
                    at = at[doc[at] == doc[at + w - 1]]
                    i = np.minimum(np.searchsorted(t, g[at]), len(t) - 1)
                    sums[w] += np.bincount(i[t[i] == g[at]], minlength=len(t))
        for w, t in tables.items():
            some = np.flatnonzero(sums[w])
            yield pa.RecordBatch.from_pydict({"width": pa.array(np.full(len(some), w, np.int32)), "token": pa.array(t[some].view(np.int64)), "n": pa.array(sums[w][some])})

    return run


def _find(win: Windows):
    """Document rows with their words, words hit (spans of word numbers) and items found."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                own = Words(batch.column("text"))
                h, before = own.hash, own.before
                n = np.diff(before)
                doc = np.repeat(np.arange(batch.num_rows), n)
                found_doc, found_at, found_win = [], [], []
                for w, (keys, wins, offset, bits) in win.lookup.items():
                    g = shingles(h, w)
                    at = np.flatnonzero(bits[(g >> U(44)).astype(np.int64)])
                    lo, hi = np.searchsorted(keys, g[at]), np.searchsorted(keys, g[at], "right")
                    at, lo, k = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                    # Hot shingles: a bounded number of pairs at a time.
                    for a, b in _groups(k, 1_000_000):
                        entry = ranges(lo[a:b], k[a:b])
                        start = np.repeat(at[a:b], k[a:b]) - offset[entry]
                        d = np.repeat(doc[at[a:b]], k[a:b])
                        wn = wins[entry]
                        fits = (start >= before[d]) & (start + win.size[wn] <= before[d + 1])
                        start, d, wn = start[fits], d[fits], wn[fits]
                        for i in range(int(win.size.max(initial=0))):
                            here = i < win.size[wn]
                            ok = ~here | (h[np.minimum(start + i, len(h) - 1)] == win.hash[np.minimum(win.first[wn] + i, len(win.hash) - 1)])
                            start, d, wn = start[ok], d[ok], wn[ok]
                        ok = win.equal(own, start, wn)
                        start, d, wn = start[ok], d[ok], wn[ok]
                        found_doc.append(d)
                        found_at.append(start)
                        found_win.append(wn)
                spans = [[] for _ in range(batch.num_rows)]
                items = [[] for _ in range(batch.num_rows)]
                if sum(map(len, found_doc)):
                    d, s, wn = (np.concatenate(x) for x in (found_doc, found_at, found_win))
                    hit = np.zeros(len(h) + 1, np.int64)
                    np.add.at(hit, s, 1)
                    np.add.at(hit, s + win.size[wn], -1)
                    inside = np.cumsum(hit)[:-1] > 0
                    # Spans don't run on from one document into the next.
                    inner = inside[1:] & inside[:-1] & (doc[1:] == doc[:-1])
                    opens = np.flatnonzero(inside & ~np.concatenate([[False], inner]))
                    shuts = np.flatnonzero(inside & ~np.concatenate([inner, [False]])) + 1
                    for o, c in zip(opens.tolist(), shuts.tolist(), strict=True):
                        spans[doc[o]].append((o - int(before[doc[o]]), c - int(before[doc[o]])))
                    pairs = np.unique(d * len(win.ids) + win.item[wn])
                    for p in pairs.tolist():
                        items[p // len(win.ids)].append(win.ids[p % len(win.ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("tie"), pa.array(n), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "tie", "n_words", "spans", "items"],
                )

    return run


_FOUND = "doc_id long, tie long, n_words long, spans array<struct<start: bigint, stop: bigint>>, items array<string>"


_OTHER = "[^0-9A-Za-z\\x80-\\x{10FFFF}]+"


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, size: int = 0):
    """Item blocks of about ``most`` words, one at a time on the driver. An item of more words is cut into pieces that overlap by ``size`` - 1 of
    them, which have the same windows of ``size``; without a size no item is cut."""
    sized = benchmark.select("item_id", "text").distinct().select("item_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), _OTHER)).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= most:
        yield sized.select("item_id", "text").toPandas()
        return
    if size:
        words_of = F.filter(F.split("text", _OTHER), lambda w: w != "")
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(most))
        long = sized.where(F.col("n") > most).select("item_id", words_of.alias("w")).select("item_id", "w", F.explode(starts).alias("i"))
        pieces = long.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, most + size - 1), " ").alias("text"))
        sized = sized.where(F.col("n") <= most).select("item_id", "text").unionByName(pieces)
    n = -(-2 * total // most)
    dealt = materialise(sized.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    for b in range(n):
        yield dealt.where(F.col("block") == b).select("item_id", "text").toPandas()


def _merged(spans):
    """Spans in order that overlap or touch, as one: what one block gives and what several give are the same."""
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x)))
    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    return F.aggregate(F.array_sort(spans), none, step)


def _found(docs: DataFrame, benchmark: DataFrame, size: int, block_words: int) -> DataFrame:
    """(doc_id, tie, n_words, spans, items) of each row, known by doc_id and a hash of its text."""
    ship_code(docs.sparkSession)
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    out, several = None, False
    for items in blocks(benchmark, block_words, size):
        win = Windows(items, size)
        if out is not None and not len(win.first):
            continue
        counts = {w: (t := win.tokens(w), np.zeros(len(t), np.int64)) for w in win.wide}
        if len(win.first):
            # At most as many rows as the block has shingles.
            for r in src.mapInArrow(_count(win), "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
                t, seen = counts[r.width]
                seen[np.searchsorted(t, np.int64(r.token).astype(U))] = r.n
        win.choose(counts)
        part = src.mapInArrow(_find(win), _FOUND).withColumn("row", F.lit(int(out is None)))
        out, several = (part, False) if out is None else (out.unionByName(part), True)
    if several:
        # Rows that repeat id and text have the same result: found once, and given back as often as the first block met them.
        every = lambda c: F.flatten(F.collect_set(c))
        out = out.groupBy("doc_id", "tie").agg(F.max("n_words").alias("n_words"), _merged(every("spans")).alias("spans"), F.array_distinct(every("items")).alias("items"), F.sum("row").alias("n"))
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select("doc_id", "tie", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items): the word spans of each document that benchmark windows cover, and whose they are."""
    return _found(docs, benchmark, size, block_words).drop("tie")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    hit = _found(docs, benchmark, size, block_words).where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), F.col("tie").alias("hit_tie")).distinct()
    # Few of many: Spark sends this table to all tasks if it is small enough, and shuffles otherwise.
    hit = materialise(hit, "contaminated", 8)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tie") == F.col("hit_tie")), "left_anti").select("row.*")


def report(found: DataFrame) -> DataFrame:
    """The digest of what ``decontaminate`` found."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end")
    )
    n_hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
