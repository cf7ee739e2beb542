"""Token ids in a compact binary format: frequency-ranked ids, byte-aligned variable-length coding, control bytes apart.

Ids are renumbered by falling frequency over the whole corpus (ties: smaller id first), so that frequent ids take one
byte. A block holds some documents: a header, their doc_ids and id counts, then control bytes (two bits an
id: how many bytes follow) and data bytes (little-endian) in two separate streams. numpy reads a block without a
loop over ids: a table turns each control byte into four lengths, and their running sum says where each id lies.

Blocks are rows of a Parquet table in ascending doc_id order (shard, block), which Spark writes and commits, so the
format works in any store that Spark can write to. The order of ranks is a table of its own beside them; it is bounded
by the vocabulary.

Null and empty texts hold the end id only. Rows that repeat, or share a doc_id, stay apart, in the order of a hash of their ids and then
of the ids, so that any number of rows may share one; rows without a doc_id come after all others, in the same order. A very long text is tokenised whole and never cut: it
makes a block of its own. An empty table gives no blocks. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.shared import materialise, partitions, ship_code, slices
from tracegrain.llm.tokenise import SLICE, chunks, from_bytes, id_bytes, with_end

MAGIC = b"TGV2"
BLOCK_IDS = 400_000
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ids = ids.astype("<u4")
    size = 1 + (ids > 0xFF).astype(np.uint8) + (ids > 0xFFFF) + (ids > 0xFFFFFF)
    code = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    code[: len(ids)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.tobytes(), ids.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers that were encoded."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_HEAD = struct.Struct("<4sII4xQQ")


def pack_block(doc_ids, sizes, ranks: np.ndarray) -> bytes:
    """A block of documents: their doc_ids (those without one last), their numbers of ids, and all ranks, one document after the other."""
    control, data = encode(ranks)
    none = sum(x is None for x in doc_ids)
    head = _HEAD.pack(MAGIC, len(doc_ids), none, len(ranks), len(control))
    return head + np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes() + control + data


def read_block(raw: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """doc_ids, how many of the last have none, numbers of ids, ranks."""
    magic, docs, none, n, width = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    ids = np.frombuffer(raw, "<i8", docs, _HEAD.size)
    sizes = np.frombuffer(raw, "<u4", docs, _HEAD.size + 8 * docs).astype(np.int64)
    at = _HEAD.size + 12 * docs
    return ids, none, sizes, decode(raw[at : at + width], raw[at + width :], n)


def _tokenise(path: str, end: int):
    """Rows of documents with their ids, and at the end of each task a row of how often it met each id."""

    def run(batches):
        tok, seen = chunks(path), np.zeros(1 << 16, np.int64)
        names = ["doc_id", "n_tokens", "ids", "seen"]
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                ids, sizes = with_end(*tok.ids(batch.column("text")), end)
                if ids.max(initial=0) >= len(seen):
                    seen = np.concatenate([seen, np.zeros(int(ids.max()) + 1 - len(seen), np.int64)])
                seen += np.bincount(ids, minlength=len(seen))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), id_bytes(ids, sizes), pa.nulls(batch.num_rows, pa.binary())], names=names)
        tok.rest()
        some = np.flatnonzero(seen)
        counts = some.astype("<u4").tobytes() + seen[some].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    return run


def _sums(batches):
    """The id counts of all tasks' rows in this one, as rows (id, n)."""
    total: dict[int, int] | np.ndarray = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column("seen").to_pylist():
            n = len(raw) // 12
            ids = np.frombuffer(raw, "<u4", n)
            if n and ids.max() >= len(total):
                total = np.concatenate([total, np.zeros(int(ids.max()) + 1 - len(total), np.int64)])
            total[ids] += np.frombuffer(raw, "<i8", n, 4 * n)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(some), "n": pa.array(total[some])})


def _blocks(rank: np.ndarray):
    def run(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        docs, parts, held = [], [], 0

        def make():
            body = pack_block(docs, [len(x) for x in parts], rank[np.concatenate(parts)])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())], names=["shard", "block", "n_ids", "body"])

        for batch in batches:
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                if docs and held + n > BLOCK_IDS:
                    yield make()
                    block, docs, parts, held = block + 1, [], [], 0
                docs.append(doc)
                parts.append(from_bytes(raw, n))
                held += n
        if docs:
            yield make()

    return run


def write_tokens(docs: DataFrame, path: str, end: int) -> tuple[DataFrame, DataFrame]:
    """Tokenise and store a corpus; the blocks and the ids by rank, as read back."""
    spark = docs.sparkSession
    ship_code(spark)
    raw = materialise(docs.select("doc_id", "text").mapInArrow(_tokenise(path, end), "doc_id long, n_tokens long, ids binary, seen binary"), "token-ids")
    counts = raw.where("seen is not null").select("seen").mapInArrow(_sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has.
    seen = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    order = np.array([r.id for r in seen], np.uint32)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    rows = raw.where("seen is null").select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("tie"))
    last = F.col("doc_id").asc_nulls_last()
    dealt = rows.repartitionByRange(partitions(spark, 2 * sum(r.n for r in seen)), last, "tie").sortWithinPartitions(last, "tie", "ids").drop("tie")
    blocks = materialise(dealt.mapInArrow(_blocks(rank), "shard long, block long, n_ids long, body binary"), "token-blocks")
    ranks = materialise(spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long"), "token-ranks")
    return blocks, ranks


def _read(order: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, body in zip(batch.column("first").to_pylist(), batch.column("body").to_pylist(), strict=True):
                doc, none, sizes, ranks = read_block(body)
                ids = order[ranks].astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=np.arange(len(doc)) >= len(doc) - none), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each document's place among all ids, their number and their checksum, from the stored blocks."""
    order = np.array([r.id for r in sorted(ranks.collect())], np.uint32)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard.
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block")
    place = blocks.select("shard", "block", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("inside")).join(base, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("first"))
    return blocks.join(place, ["shard", "block"]).select("first", "body").mapInArrow(_read(order), "doc_id long, start long, n_tokens long, ids_crc32 long")
