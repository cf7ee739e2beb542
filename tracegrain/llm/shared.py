"""Small helpers that the training-data operators have in common."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrain.sources import scratch
from tracegrain.sources.scratch import materialise  # noqa: F401  for this subpackage's modules

U = np.uint64
def ship_code(spark: SparkSession) -> None:
    """Get a session ready for this package's tasks.

    Whole texts go to Python in batches, in buffers on both sides: unless the session says otherwise, a batch has a
    thousand rows, not ten thousand."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "1000")
    scratch.ship_code(spark)


#: Bytes that a partition should hold.
PARTITION = 1 << 26


def partitions(spark: SparkSession, size: int | None = 0) -> int:
    """The session's number of shuffle partitions, or more where so many bytes need them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PARTITION))


def carried(docs: DataFrame, carry: tuple[str, ...], out: str, *more) -> tuple[DataFrame, StructType]:
    """doc_id and text (and ``more``) with a struct ``carried`` of other columns, and the schema ``out`` with that struct behind it.

    What a row's verdict decides can then be done to that row, without a join on ids that may repeat or be missing."""
    schema = StructType.fromDDL(out)
    if not carry:
        return docs.select("doc_id", "text", *more), schema
    rows = docs.select("doc_id", "text", *more, F.struct(*carry).alias("carried"))
    return rows, schema.add(rows.schema["carried"])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place on a copy."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_seed = np.random.default_rng(20240607)
#: A random 64-bit value for each byte and an odd base; sums of BYTE[b] * BASE**i modulo 2**64 tell windows of bounded size apart.
#: Words and other strings of any length are not hashed so: texts made by doubling would collide.
BYTE = _seed.integers(0, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
_inv = pow(int(BASE), -1, 2**64)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    up, down = np.full(n, BASE, U), np.full(n, U(_inv), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow array, one after the other, and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch, text: str = "text", most: int = 1 << 20):
    """Cut a record batch into runs of rows with about ``most`` bytes of text (one row at least), which bounds the
    memory of what works on whole texts; a run is longer only where a single text is."""
    at = utf8(batch.column(text))[1] if isinstance(text, str) else text
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after folding A-Z: digits, a-z and every byte of a character beyond ASCII.
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = _PLAIN[128:] = True


def fold(raw: np.ndarray) -> np.ndarray:
    return _FOLD[raw]


def words(raw: np.ndarray, at: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, and how many words lie before each of the offsets ``at``.
    Words are runs of bytes that are not white space, or with ``plain`` runs of letters and digits."""
    inside = _PLAIN[raw] if plain else ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Words of more bytes go to xxh3 one by one.
LONG = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, whatever its place: eight bytes at a time through a finaliser, or xxh3 for long words."""
    if not len(starts):
        return np.zeros(0, U)
    import xxhash

    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    out = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    left = np.arange(len(starts)) if size.max() <= LONG else np.flatnonzero(size <= LONG)
    at = 0
    while len(left):
        eight = np.ascontiguousarray(blocks[starts[left] + at]).view("<u8").reshape(-1)
        eight &= _LOW[np.minimum(size[left] - at, 8)]
        out[left] = mix(out[left] ^ eight) + U(at + 1)
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbouring words, for every place at which n words are left in the array."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, U)
    out = np.zeros(k, U)
    for i in range(n):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[i : i + k]
    return mix(out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each start, one after the other."""
    sizes = sizes.astype(np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts.astype(np.int64) - before, sizes) + np.arange(int(sizes.sum()))
