"""Packing documents into training sequences along a space-filling curve.

A document's words are hashed to random signs in a few dimensions; their sums, scaled by the square root of
the word count, are near for documents with the same wording. A Hilbert curve through that space gives each document a
key, Spark range-sorts by it, and each range lays its documents end to end and cuts them every ``length`` ids, so that a
sequence holds neighbours on the curve. What is left at the end of a range becomes sequences of powers of two, which
need no padding.

Null and empty texts are the end id only; equal texts have equal keys and are neighbours (ties go by doc_id, null first, then by
ids); keys are split over ranges by doc_id too, so many copies don't meet in one task. Rows that repeat, share an id or have none
are packed each by itself. A very long text is tokenised whole and cut over as many sequences as it needs. An empty table gives no
pieces; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import U, fold, materialise, mix, partitions, ship_code, slices, utf8, word_hashes, words
from tracegrain.llm.tokenise import SLICE, chunks, from_bytes, id_bytes, with_end

DIMS, BITS = 4, 12


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points (rows) whose coordinates have this many bits.

    Walks down from the highest bit: at each level the curve's orientation is a Gray code of the cell, undone by exchanging
    or flipping the lower bits of two axes."""
    x = [axes[:, i].astype(U) for i in range(axes.shape[1])]
    top = U(1) << U(bits - 1)
    q = top
    while q > U(1):
        low = q - U(1)
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, U(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= U(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(axes), U)
    q = top
    while q > U(1):
        turn = np.where((x[-1] & q) != 0, turn ^ (q - U(1)), turn)
        q >>= U(1)
    key = np.zeros(len(axes), U)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << U(1) | ((v ^ turn) >> U(b) & U(1))
    return key.astype(np.int64)


def project(texts, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Whole-number coordinates of texts."""
    raw, at = utf8(texts)
    raw = fold(raw)
    starts, ends, before = words(raw, at, plain=True)
    h = mix(word_hashes(raw, starts, ends) ^ U(0x5DEECE66D))
    n = np.maximum(np.diff(before), 1)
    out = np.zeros((len(n), dims), np.int64)
    for d in range(dims):
        total = np.concatenate([[0], np.cumsum((h >> U(d) & U(1)).astype(np.int64) * 2 - 1)])
        z = np.diff(total[before]) / np.sqrt(n)
        # A logistic curve spreads the sums about evenly over the cells.
        out[:, d] = np.minimum((1 << bits) / (1 + np.exp(-np.clip(z, -30, 30) / 2)), (1 << bits) - 1).astype(np.int64)
    return out


def _prepare(path: str, end: int):
    def run(batches):
        tok = chunks(path)
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                key = hilbert(project(batch.column("text")), BITS)
                ids, sizes = with_end(*tok.ids(batch.column("text")), end)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key), pa.array(sizes), id_bytes(ids, sizes)], names=["doc_id", "curve", "n", "ids"])
        tok.rest()

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(length: int, keep_ids: bool):
    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * keep_ids

    def run(batches):
        from pyspark import TaskContext

        base, local = TaskContext.get().partitionId() << 40, 0
        open_: list[tuple] = []  # pieces of the sequence that is not full
        fill = 0
        out: list[tuple] = []

        def emit(piece, sequence, offset):
            doc, start, ids, total = piece
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + sequence, offset)
            out.append((*row, ids.tolist()) if keep_ids else row)

        def table():
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
            cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                ids = from_bytes(raw, n)
                at = 0
                while at < n:
                    take = min(n - at, length - fill)
                    open_.append((doc, at, ids[at : at + take], n))
                    at += take
                    fill += take
                    if fill == length:
                        offset = 0
                        for p in open_:
                            emit(p, local, offset)
                            offset += len(p[2])
                        local, fill, open_ = local + 1, 0, []
            yield table()
            out = []
        # The rest, as sequences of falling powers of two.
        rest = fill
        offset, room = 0, 1 << (rest.bit_length() - 1) if rest else 0
        for doc, start, ids, total in open_:
            while len(ids):
                take = min(len(ids), room - offset)
                emit((doc, start, ids[:take], total), local, offset)
                ids, start, offset = ids[take:], start + take, offset + take
                if offset == room:
                    rest -= room
                    local, offset, room = local + 1, 0, 1 << (rest.bit_length() - 1) if rest else 0
        if out:
            yield table()

    return run


def pack(docs: DataFrame, path: str, end: int, length: int = 2048, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places in sequences; with ``keep_ids`` their ids too."""
    spark = docs.sparkSession
    ship_code(spark)
    ready = materialise(docs.select("doc_id", "text").mapInArrow(_prepare(path, end), "doc_id long, curve long, n long, ids binary"), "curve")
    # Two bytes an id.
    n = partitions(spark, 2 * (ready.agg(F.sum("n")).first()[0] or 0))
    dealt = ready.repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return dealt.select("doc_id", "n", "ids").mapInArrow(_pack(length, keep_ids), _PIECES + ", ids array<int>" * keep_ids)
