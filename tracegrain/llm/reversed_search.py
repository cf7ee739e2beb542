"""Ranked lexical search turned round: the items are indexed, and the documents stream through the index.

An inverted index over the items' terms (term -> items, with how often each has it) goes to all tasks. A task counts each document's
terms, looks the counts up in the index, and adds up the scores of the items that share terms with it; each item has a heap of its
``top`` best documents so far, whatever the number of documents. At its end a task gives its heaps, and the heaps of all
tasks are merged, first in ``SALT`` groups an item, then those. Documents are never shuffled, and nothing of them passes the driver but N, L and the
document frequencies of the items' terms.

The items come in blocks of at most about ``block_words`` words (an item is never cut), which bounds the index and the heaps that a
task holds: a larger set of items takes more passes over the documents.

A term is a run of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Null texts have no terms; a document
without terms counts in neither N nor L and is never found; an item without terms, or whose terms no document has, finds nothing. Very
long texts are counted whole. Equal scores are ranked by doc_id, those without one last, and rows that share both in any order, as
they are equal in the result; each row of the documents is a document of its own. Item rows that repeat id and text are one item; items that share an id and
differ in text are ranked each for itself. Empty documents or items give no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.decontam import BLOCK_WORDS, blocks
from tracegrain.llm.shared import _PLAIN, fold, ranges, ship_code, slices, utf8, words

TOP = 10
#: Groups in which an item's heaps are merged first.
SALT = 32
#: Cells of the table of scores (documents x items) that is filled at once.
CELLS = 1 << 20


def terms(texts) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, one text after the other, and how many lie before each text."""
    raw, at = utf8(texts)
    raw = fold(raw)
    starts, ends, before = words(raw, at, plain=True)
    stops = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(raw[_PLAIN[raw]]))), before


class Index:
    """Terms of a block of items, and for each term the items that have it and how often."""

    def __init__(self, items: pd.DataFrame):
        own, before = terms(pa.array(items["text"], pa.string()))
        coded = own.dictionary_encode()
        self.terms, n = coded.dictionary, max(len(items), 1)
        of = np.repeat(np.arange(len(items)), np.diff(before))
        pairs, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
        self.items, self.n_items, self.times = pairs % n, n, times.astype(np.int64)
        self.first = np.searchsorted(pairs // n, np.arange(len(self.terms) + 1))
        self.names = pa.array(items["item_id"], pa.string())
        self.most = int(np.diff(before).max(initial=0))

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The index's terms in each text: text, term, occurrences; and how many terms each text has in all."""
        own, before = terms(texts)
        term = pc.index_in(own, value_set=self.terms).fill_null(-1).to_numpy()
        doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
        some = term >= 0
        pairs, tf = np.unique(doc[some] * len(self.terms) + term[some], return_counts=True)
        return pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1), tf.astype(np.int64), np.diff(before)


def _frequencies(index: Index):
    """How many documents have each term; as terms -1 and -2 the documents that have any, and the terms of all."""

    def run(batches):
        df, n_docs, n_terms = np.zeros(len(index.terms), np.int64), 0, 0
        for whole in batches:
            for batch in slices(whole):
                _, term, _, size = index.counts(batch.column("text"))
                df += np.bincount(term, minlength=len(df))
                n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + int(size.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(some, [-1, -2]).astype(np.int64)), "n": pa.array(np.append(df[some], [n_docs, n_terms]).astype(np.int64))})

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The ``top`` best documents of each item so far: rows sorted by item, best first."""

    def __init__(self, n_items: int, top: int):
        self.top, self.rows = top, [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64)]
        #: What a document needs to come in.
        self.least = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        """Take in a table of scores, a row for each document (``none``: it has no id)."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, score, none, doc = (np.concatenate(x) for x in zip(self.rows, (item, scores[row, item], none[row], doc[row]), strict=True))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        order = order[keep]
        self.rows = [item[keep], score[order], none[order], doc[order]]
        full = place[keep] == self.top - 1
        self.least[self.rows[0][full]] = self.rows[1][full]


def _search(index: Index, n_docs: int, n_terms: int, df: np.ndarray, block: int, top: int):
    """The heaps of a task's documents, as rows (block, item, item_id, doc_id, score)."""
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    spread = np.diff(index.first)
    # Sums of whole numbers are exact in doubles up to 2 ** 53.
    exact = index.most * int(weights.max(initial=0)) * 1_000_000 < 2**53

    def run(batches):
        heaps = Heaps(index.n_items, top)
        for whole in batches:
            for batch in slices(whole):
                doc, term, tf, size = index.counts(batch.column("text"))
                m = np.array([25 + 75 * n * n_docs // max(n_terms, 1) for n in size.tolist()], np.int64)
                each = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                some = each > 0
                doc, term, each = doc[some], term[some], each[some]
                ids = batch.column("doc_id")
                none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                rows = max(1, CELLS // index.n_items)
                for i in range(0, batch.num_rows, rows):
                    n = min(rows, batch.num_rows - i)
                    own = slice(*np.searchsorted(doc, [i, i + n]))
                    at = ranges(index.first[term[own]], spread[term[own]])
                    cell = np.repeat((doc[own] - i) * index.n_items, spread[term[own]]) + index.items[at]
                    more = np.repeat(each[own], spread[term[own]]) * index.times[at]
                    if exact:
                        scores = np.bincount(cell, more, n * index.n_items).astype(np.int64)
                    else:
                        scores = np.zeros(n * index.n_items, np.int64)
                        np.add.at(scores, cell, more)
                    heaps.add(scores.reshape(n, -1), none[i : i + n], ids[i : i + n])
        item, score, none, doc = heaps.rows
        yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(item), block, np.int64)), "item": pa.array(item), "item_id": index.names.take(pa.array(item)), "doc_id": pa.array(doc, mask=none), "score": pa.array(score)})

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    spark = docs.sparkSession
    ship_code(spark)
    rows, kind = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items.schema["item_id"].dataType
    found = None
    # Ids travel as strings: a missing one stays what it is.
    for block, own in enumerate(blocks(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), block_words)):
        index = Index(own)
        # At most as many rows as the block has terms.
        df, sums = np.zeros(len(index.terms), np.int64), {}
        for r in rows.select("text").mapInArrow(_frequencies(index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
            if r.term < 0:
                sums[r.term] = int(r.n)
            else:
                df[r.term] = r.n
        part = rows.mapInArrow(_search(index, sums.get(-1, 0), sums.get(-2, 0), df, block, top), "block long, item long, item_id string, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    best = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = Window.partitionBy("block", "item", "salt").orderBy(*best)
    last = Window.partitionBy("block", "item").orderBy(*best)
    some = found.withColumn("salt", F.spark_partition_id() % SALT).withColumn("place", F.row_number().over(first)).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


#: DuckDB SQL for the rows of ``search`` on the given tables.
ORACLE_SQL = """
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
counts AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
df AS (SELECT t, count(*) AS df FROM counts GROUP BY t),
wanted AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(q * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN counts USING (t) JOIN df USING (t) JOIN size USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
