"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are joined where both sides are proven right.

A text of more than ``chunk`` characters is cut into chunks that overlap by ``overlap`` characters, each a row of its own, so that
many tasks share a huge text and none holds more of it than a chunk. Each chunk is encoded with offsets; of its
tokens only those in the overlaps are told, and each two neighbouring chunks look for a common boundary there:

- A boundary between words (the vocabulary's own pre-tokens) that both chunks have. The pattern reads a text from left to right, and where
  it stands is all it knows: from a common boundary on, the right chunk is cut as the whole text is. The left one's
  boundaries are those of the whole text up to a margin before its end, which is longer than what the pattern looks ahead and than
  the name of any special token.
- A boundary between tokens inside a long word of both, if the left chunk's token before it and the right chunk's token behind it, put
  together, are encoded as these two. Byte-pair encodings in which any two neighbours are so are the only ones of their
  text, so the left tokens up to there and the right ones from there on are the whole word's.

What the left chunk has behind the boundary and the right one before it is taken off the sum: the pairs are independent rows, however long
a text is. Where a pair has no such boundary, its text is cut again with chunks and overlaps ``widen`` times as long, until
every pair has one or a chunk is the whole text.

Null and empty texts have no tokens. Short texts go through ``tokenise``. A tokenizer whose words aren't known to ``tokenise`` (or a
sentencepiece model, by its name's end) encodes whole texts. Each row has a row of its own, also where rows repeat, share an id or have
none: a text's chunks are known by doc_id and a hash of the text, and rows that repeat both are counted. An empty table
gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import materialise, ship_code, slices, utf8
from tracegrain.llm.tokenise import SLICE, _load, chunks

CHUNK, OVERLAP, WIDEN = 1 << 14, 1 << 9, 4
#: Characters that the known patterns look at beyond a word's end, with room to spare.
LOOK = 8
#: A word longer than this before a boundary is a run of one kind of characters: the pattern's other words are shorter.
RUN = 4
#: Chunks that go to the library at once.
TOGETHER = 32


def _whole(path: str):
    """Counts of whole texts by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)
    return lambda texts: chunks(path).ids(texts)[1]


def _count(path: str):
    def run(batches):
        sizes = _whole(path)
        for whole in batches:
            for batch in slices(whole, most=SLICE):
                texts = batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(utf8(texts)[1]), pa.int64()), pa.array(sizes(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        if not path.endswith(".model"):
            chunks(path).rest()

    return run


_PIECES = "doc_id long, tie long, n_bytes long, part long, start long, last boolean, text string"


def _cut(chunk: int, overlap: int):
    """Chunks of each text: its first ``chunk`` characters, then from ``overlap`` before each chunk's end on."""

    def run(batches):
        step = chunk - overlap
        for whole in batches:
            for batch in slices(whole):
                n_bytes = np.diff(utf8(batch.column("text"))[1]).tolist()
                for doc, tie, size, text in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), n_bytes, batch.column("text").to_pylist(), strict=True):
                    n = max(1, -(-(len(text) - overlap) // step))
                    for i in range(0, n, 64):
                        some = range(i, min(i + 64, n))
                        k = len(some)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * k, pa.int64()), "tie": pa.array([tie] * k, pa.int64()), "n_bytes": pa.array([size] * k, pa.int64()), "part": pa.array(some, pa.int64()), "start": pa.array([j * step for j in some], pa.int64()), "last": [j == n - 1 for j in some], "text": [text[j * step : j * step + chunk] for j in some]})

    return run


def boundaries(enc, lo: int, hi: int) -> np.ndarray:
    """The token boundaries of an encoding from character ``lo`` to ``hi``, as rows: character, number of tokens before it, the token before,
    the token behind, and what the boundary is: 2 between words, 1 inside a long word, 0 inside a short one."""
    n = len(enc.ids)
    if n < 2:
        return np.zeros((5, 0), np.int64)
    at, ids = np.array(enc.offsets, np.int64), np.array(enc.ids, np.int64)
    word = np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
    fresh = np.concatenate([[True], word[1:] != word[:-1]])
    opens = at[np.maximum.accumulate(np.where(fresh, np.arange(n), 0)), 0]
    k = np.arange(1, n)
    p = at[1:, 0]
    k = k[(at[:-1, 1] <= p) & (p >= lo) & (p <= hi) & (p > at[:-1, 0])]
    p = at[k, 0]
    kind = np.where(fresh[k], 2, (p - opens[k] >= RUN).astype(np.int64))
    return np.stack([p, k, ids[k - 1], ids[k], kind])


_TOLD = "doc_id long, tie long, n_bytes long, part long, n long, left binary, right binary"


def _encode(path: str, overlap: int):
    """Of each chunk its number of tokens, and the boundaries in its overlaps as row ``part`` - 1 (right side of that pair) and ``part``."""

    def run(batches):
        tok, _, _, names, _ = _load(path)
        margin = LOOK + max((len(x) for x in names), default=0)
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                out = []
                rows = whole.slice(i, TOGETHER).to_pylist()
                for r, enc in zip(rows, tok.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
                    size, known = len(r["text"]), (r["doc_id"], r["tie"], r["n_bytes"])
                    told = lambda b, start=r["start"]: (b + np.array([[start], [0], [0], [0], [0]])).tobytes()
                    out.append((*known, r["part"], len(enc.ids), None, told(boundaries(enc, size - overlap, size - margin)) if not r["last"] else None))
                    if r["part"]:
                        out.append((*known, r["part"] - 1, None, told(boundaries(enc, 1, overlap)), None))
                kinds = (pa.int64(),) * 5 + (pa.binary(),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "tie", "n_bytes", "part", "n", "left", "right"])

    return run


@cache
def _pairs_of(path: str):
    """Whether two tokens, put together, are encoded as these two."""
    tok = _load(path)[0]

    @cache
    def valid(a: int, b: int) -> bool:
        x, y = tok.id_to_token(a), tok.id_to_token(b)
        return [t.id for t in tok.model.tokenize(x + y)] == [a, b]

    return valid


def splice(ahead: np.ndarray, behind: np.ndarray, valid) -> tuple[int, int] | None:
    """Numbers of tokens before a proven common boundary, in the chunk ahead and in the one behind it; None without one."""
    _, i, j = np.intersect1d(ahead[0], behind[0], return_indices=True)
    words = np.flatnonzero((ahead[4, i] == 2) & (behind[4, j] == 2))
    if len(words):
        k = words[0]
        return int(ahead[1, i[k]]), int(behind[1, j[k]])
    for k in np.flatnonzero((ahead[4, i] == 1) & (behind[4, j] == 1)).tolist():
        if valid(int(ahead[2, i[k]]), int(behind[3, j[k]])):
            return int(ahead[1, i[k]]), int(behind[1, j[k]])
    return None


def _splice(path: str):
    """Of each pair the tokens that both chunks count or that only one of them has wrongly; null where it has no common boundary. A text's
    last chunk is in no pair as the one ahead."""

    def run(batches):
        valid = _pairs_of(path)
        table = lambda raw: np.frombuffer(raw, np.int64).reshape(5, -1)
        for batch in batches:
            extra = []
            for n, ahead, behind in zip(*(batch.column(c).to_pylist() for c in ("n", "right", "left")), strict=True):
                at = (n, 0) if ahead is None else splice(table(ahead), table(behind), valid)
                extra.append(None if at is None else n - at[0] + at[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tie", "n_bytes", "copies", "n")), pa.array(extra, pa.int64())], names=["doc_id", "tie", "n_bytes", "copies", "n", "extra"])

    return run


_PAIR = "doc_id long, tie long, n_bytes long, copies long, n long, extra long"


def _counted(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, tie, n_bytes, copies, n_tokens) of long texts; n_tokens is null where a pair of chunks has no common boundary."""
    pieces = long.mapInArrow(_cut(chunk, overlap), _PIECES).repartition("doc_id", "tie", "part")
    told = pieces.mapInArrow(_encode(path, overlap), _TOLD)
    # Rows that repeat say the same: one of them counts, and how many there were.
    pairs = told.groupBy("doc_id", "tie", "n_bytes", "part").agg(F.count("n").alias("copies"), F.max("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    of_text = pairs.mapInArrow(_splice(path), _PAIR).groupBy("doc_id", "tie", "n_bytes").agg(F.max("copies").alias("copies"), (F.sum("n") - F.sum("extra")).alias("n_tokens"), F.count_if(F.col("extra").isNull()).alias("open"))
    return of_text.select("doc_id", "tie", "n_bytes", "copies", F.when(F.col("open") == 0, F.col("n_tokens")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP, widen: int = WIDEN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text, for the tokenizer at ``path``."""
    if chunk < 2 * overlap or overlap < 1:
        raise ValueError("a chunk is at least two overlaps long")
    ship_code(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    proven = not path.endswith(".model") and _load(path)[2] == "spaced"
    huge = F.coalesce(F.length("text") > chunk, F.lit(False))
    out = (rows.where(~huge) if proven else rows).mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    open_ = rows.where(huge).withColumn("tie", F.xxhash64("text")) if proven else None
    while open_ is not None:
        done = materialise(_counted(open_, path, chunk, overlap), "token-counts", 8)
        found = done.where("n_tokens is not null")
        out = out.unionByName(found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_bytes", "n_tokens"))
        left = done.where("n_tokens is null").select(F.col("doc_id").alias("of"), F.col("tie").alias("hash"))
        chunk, overlap = widen * chunk, widen * overlap
        again = open_.join(left, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("hash")), "left_semi")
        open_ = again if left.limit(1).count() else None
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
