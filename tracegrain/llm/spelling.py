"""Spelling variants of a corpus' words: one-edit neighbourhoods over a reduced alphabet, verified on the words themselves.

``vocabulary`` counts the words of whole texts. Each task adds up its own counts before it gives them, within ``HELD`` rows, so
that a frequent word is few rows of a task, not one for each occurrence.

``near_pairs`` hashes the letters to ``SYMBOLS`` symbols. Words one edit apart have reduced words at most one edit apart, so each word is
filed under its reduced word, and asks for all of its full one-edit neighbourhood there: the reduced word itself, and every deletion,
replacement and insertion. With so few symbols a neighbourhood has some 75 words, whatever the alphabet, but a reduced
word has many words. Where the edit is is known for each of these, and leaves the first or the last ``EDGE`` characters as they are: these go
into the key. So a key has words that agree in them and, but for one edit, in what the letters are hashed to. Spark joins
these keys; a pair counts if the words themselves differ in exactly one inserted, deleted or replaced code point. A word has at
most a few thousand such neighbours, however many words there are.

``variants`` takes each word's near word of largest count as its form, if it is ``ratio`` times as frequent, and follows forms to the root by
doubling: after k rounds each word has looked 2^k forms ahead. Counts grow ``ratio``-fold with each form, so a few rounds do.

Null and empty texts have no words. A row's words are dropped a letter by its own doc_id (a null one counts as an empty string); rows that
repeat count each; very long texts are read whole. Of near words with the largest count the first in code-point order is the form. An
empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import U, fold, materialise, mix, ship_code, slices, utf8

#: Words that a task counts before it gives the counts.
HELD = 400_000
#: Bytes of text that a task looks at together.
SLICE = 1 << 21
SYMBOLS, EDGE = 4, 3
#: Every word in 199 of a document loses a letter; words have six code points or more, occur five times or more, and
#: a form is five times as frequent.
DROP, LEAST, SEEN, RATIO = 199, 6, 5, 5

_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of [A-Za-z] and U+00C0 to U+00FF (two bytes, of which the first is C3) in texts laid end to end."""
    lead = raw == 0xC3
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _sums(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _count(drop: int, least: int):
    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                raw, at = utf8(batch.column("text"))
                raw = fold(raw)
                starts, ends = runs(raw, at)
                # Bytes are at least as many as code points, and a shorter word is none, whether it loses a letter or not.
                long = ends - starts >= least
                starts, ends = starts[long], ends[long]
                if not len(starts):
                    continue
                doc = np.searchsorted(at, starts, "right") - 1
                cut = np.zeros(len(raw) + 1, np.int8)
                cut[starts] = 1
                cut[ends] -= 1
                stops = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
                own = np.ascontiguousarray(raw[np.cumsum(cut, dtype=np.int8)[:-1] > 0])
                coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops), pa.py_buffer(own)).dictionary_encode()
                names = coded.dictionary
                size, raws = pc.utf8_length(names).to_numpy(), names.cast(pa.large_binary()).to_pylist()
                pairs, times = np.unique(doc * len(names) + coded.indices.to_numpy(), return_counts=True)
                head = [zlib.crc32(b"%s:" % (b"" if x is None else str(x).encode())) for x in batch.column("doc_id").to_pylist()]
                who, word = pairs // len(names), pairs % len(names)
                crc = np.fromiter(map(zlib.crc32, map(raws.__getitem__, word.tolist()), map(head.__getitem__, who.tolist())), np.int64, len(pairs))
                odd = crc % drop == 0
                total = np.bincount(word[~odd], times[~odd], len(names)).astype(np.int64)
                some = np.flatnonzero((total > 0) & (size >= least))
                fewer = [(x[: h % len(x)] + x[h % len(x) + 1 :], n) for x, h, n in zip((raws[w].decode() for w in word[odd].tolist()), crc[odd].tolist(), times[odd].tolist(), strict=True) if len(x) > least]
                held.append(pa.table({"word": pa.concat_arrays([names.take(pa.array(some)), pa.array([x for x, _ in fewer], pa.large_string())]), "n": pa.concat_arrays([pa.array(total[some]), pa.array([n for _, n in fewer], pa.int64())])}))
                rows += held[-1].num_rows
                if rows >= HELD:
                    held = [_sums(held)]
                    rows = held[0].num_rows
                    if rows >= HELD // 2:
                        yield from held[0].cast(_WORDS).to_batches()
                        held, rows = [], 0
        if held:
            yield from _sums(held).cast(_WORDS).to_batches()

    return run


_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def vocabulary(docs: DataFrame, drop: int = DROP, least: int = LEAST, seen: int = SEEN) -> DataFrame:
    """(word, n): the words of the texts, after the losses, and how often they occur."""
    ship_code(docs.sparkSession)
    parts = docs.select("doc_id", "text").mapInArrow(_count(drop, least), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)


def _hash(symbols: np.ndarray, side: int, edge: np.ndarray) -> np.ndarray:
    """Keys of reduced words (rows of symbols) with the characters of an edge."""
    h = np.full(len(symbols), U(symbols.shape[1] * 2 + side))
    for k in range(symbols.shape[1]):
        h = h * U(0x9E3779B97F4A7C15) + symbols[:, k].astype(U) + U(1)
    for k in range(edge.shape[1]):
        h = h * U(0xD6E8FEB86659FD93) + edge[:, k].astype(U)
    return mix(h)


def _by_length(words: list[str]):
    """Words as rows of code points, those of one length at a time, and their places."""
    size = np.array([len(x) for x in words])
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), "<u4").reshape(len(at), n)


def _symbols(code: np.ndarray, symbols: int) -> np.ndarray:
    return (mix(code.astype(U) + U(0x5851F42D)) % U(symbols)).astype(np.uint8)


def filed(words: list[str], symbols: int = SYMBOLS):
    """(places, keys): each word's reduced word, with its first and with its last characters."""
    for at, code in _by_length(words):
        r = _symbols(code, symbols)
        yield np.tile(at, 2), np.concatenate([_hash(r, 0, code[:, :EDGE]), _hash(r, 1, code[:, -EDGE:])])


def asked(words: list[str], symbols: int = SYMBOLS):
    """(places, keys): each word's full one-edit neighbourhood over the reduced alphabet. An edit before character ``EDGE`` leaves the last
    characters as they are, one behind it the first."""
    for at, code in _by_length(words):
        r, n = _symbols(code, symbols), code.shape[1]
        edge = lambda i: (1, code[:, -EDGE:]) if i < EDGE else (0, code[:, :EDGE])
        keys = []
        for i in range(n):
            keys.append(_hash(np.delete(r, i, 1), *edge(i)))
            other = r.copy()
            # All symbols, its own among them: other letters may be hashed alike.
            for s in range(symbols):
                other[:, i] = s
                keys.append(_hash(other, *edge(i)))
        for i in range(n + 1):
            for s in range(symbols):
                keys.append(_hash(np.insert(r, i, s, 1), *edge(i)))
        every = np.sort(np.stack(keys, 1), axis=1)
        fresh = np.ones(every.shape, bool)
        fresh[:, 1:] = every[:, 1:] != every[:, :-1]
        row, col = np.nonzero(fresh)
        yield at[row], every[row, col]


def _keys(make, symbols: int, most: int = 2000):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, most):
                batch = whole.slice(i, most)
                for place, key in make(batch.column("word").to_pylist(), symbols):
                    own = batch.take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), own.column("word"), own.column("n")], names=["key", "word", "n"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): each word with each word that is one edit away; ``words`` (word, n) has no word twice, and none of fewer than
    ``2 * EDGE`` characters."""
    own = words.mapInArrow(_keys(asked, symbols), "key long, word string, n long").select("key", "word")
    other = words.mapInArrow(_keys(filed, symbols), "key long, word string, n long").select(F.col("key").alias("at"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    one = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    # By the vocabulary's compressed file Spark would send all filed words, two rows each, through the driver. A pair may meet under several keys.
    return own.join(other.hint("merge"), (F.col("key") == F.col("at")) & one).groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary (word, n)."""
    words = materialise(words, "vocabulary", 2)
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    # Nothing that grows with the vocabulary is broadcast: its tables are several times their files' size in memory.
    formed = words.join(near.hint("merge"), "word", "left").withColumn("fits", -F.col("best.less") >= ratio * F.col("n"))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("best.form")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"))
    formed = materialise(formed, "forms", 2)
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(up.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", 2)
        up = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    return formed.join(up.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB SQL for op11's rows on the given tables. crc32 goes byte by byte over a table of its 256 steps; of near words, those that agree but for one
#: left out character meet.
ORACLE_SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
run AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || substr(hex(b), 2 * i::INT - 1, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h
  FROM (SELECT w, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || w) AS b FROM run), crc),
word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
short AS (SELECT word, i::INT AS i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM word, unnest(range(1, length(word) + 1)) r(i)),
near AS (
  SELECT a.word, b.word AS other FROM short a JOIN short b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM short s JOIN word w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM short s JOIN word w ON s.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM (SELECT near.word, other, o.n FROM near JOIN word o ON o.word = other) GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM word LEFT JOIN best USING (word)),
root AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM root r JOIN formed f ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
"""
