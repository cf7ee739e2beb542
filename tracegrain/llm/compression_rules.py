"""Quality rules on whole texts: a few word counts, then compression bands.

A text is rejected if zstandard shrinks it far more (repetitive) or far less (incompressible) than prose of its length,
over the whole text or over more than ``chunk_share`` of its fixed chunks. Short texts hardly compress and long ones
compress well, so each length has limits of its own. The last chunk ends where the text does, so that it is as long as the others
and overlaps the one before it; a text below one chunk is judged as a whole only.

The limits are parameters. Those given here leave room around invented prose in four languages: ``ratio_quantiles`` gives the
quantiles of the ratios by length of any corpus, from which limits for it can be read off.

Null and empty texts have no words and fail the base rules. A very long text is compressed whole, and in all its chunks. The
result has one row for each input row, in whatever way rows repeat or share an id, or have none; a ratio at a limit is within it;
an empty table gives no rows; other columns, whatever their names, are not looked at, but carried along where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import _SPACE, U, carried, mix, shingles, ship_code, slices, utf8, word_hashes, words

#: Up to so many bytes, the least and the largest ratio of plain to compressed size.
BANDS = ((64, 0.40, 1.40), (128, 0.60, 1.80), (256, 0.85, 2.40), (512, 1.10, 2.50), (1024, 1.25, 2.70), (4096, 1.40, 2.80), (16384, 1.45, 3.00), (65536, 1.50, 3.30), (float("inf"), 1.50, 3.80))


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    repeat_percent: int = 50
    bands: tuple = BANDS
    chunk: int = 4096
    chunk_least: float = 1.40
    chunk_most: float = 3.00
    chunk_share: float = 0.2
    level: int = 3


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return n


def repeated_words(h: np.ndarray, before: np.ndarray, n: int = 3) -> np.ndarray:
    """For each text the words in windows of n words that the text has twice or more."""
    out = np.zeros(len(before) - 1, np.int64)
    g = shingles(h, n)
    if not len(g):
        return out
    doc = np.repeat(np.arange(len(out)), np.diff(before))
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
    key = mix(g[at] + doc[at].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(h), bool)
    for i in range(n):
        hit[at[order[twice]] + i] = True
    np.add.at(out, doc[hit], 1)
    return out


def _judge(lim: Limits):
    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=lim.level, write_checksum=False)
        tops = np.array([b[0] for b in lim.bands])
        for whole in batches:
            for batch in slices(whole):
                raw, at = utf8(batch.column("text"))
                starts, ends, before = words(raw, at)
                n_words = np.diff(before)
                space = _SPACE[raw]
                total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])
                chars = total(((raw & 0xC0) != 0x80) & ~space)
                symbols = total(_SYMBOL[raw])
                repeats = repeated_words(word_hashes(raw, starts, ends), before)
                lines = np.array([_dup_lines(x) if x else 0 for x in batch.column("text").to_pylist()], np.int64)
                failed = (n_words < lim.min_words) | (100 * repeats > lim.repeat_percent * n_words)
                size = np.diff(at)
                least, most = (np.array([b[k] for b in lim.bands]) for k in (1, 2))
                ratio, odd_chunks = np.zeros(len(n_words)), np.zeros(len(n_words), np.int64)
                n_chunks = np.where(size >= lim.chunk, -(-size // lim.chunk), 0)
                for i in range(len(n_words)):
                    text = raw[at[i] : at[i + 1]].tobytes()
                    if text:
                        ratio[i] = len(text) / len(z.compress(text))
                    for j in range(n_chunks[i]):
                        begin = min(j * lim.chunk, len(text) - lim.chunk)
                        r = lim.chunk / len(z.compress(text[begin : begin + lim.chunk]))
                        odd_chunks[i] += not lim.chunk_least <= r <= lim.chunk_most
                band = np.searchsorted(tops, size)
                kept = ~failed & (ratio >= least[band]) & (ratio <= most[band]) & (odd_chunks <= lim.chunk_share * n_chunks)
                out = {"doc_id": batch.column("doc_id"), "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeats, "base_failed": failed, "kept": kept, "ratio": ratio, "n_chunks": n_chunks, "n_odd_chunks": odd_chunks}
                cols = [x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()]
                carried = [batch.column("carried")] if "carried" in batch.schema.names else []
                yield pa.RecordBatch.from_arrays(cols + carried, names=[*out, *["carried"] * len(carried)])

    return run


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_odd_chunks long"


def compression_rules(docs: DataFrame, limits: Limits = Limits(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Figures and verdict of each row, with the columns ``carry`` in a struct ``carried``; one pass, no shuffle."""
    ship_code(docs.sparkSession)
    rows, out = carried(docs, carry, _OUT)
    return rows.mapInArrow(_judge(limits), out)


def ratio_quantiles(docs: DataFrame, limits: Limits = Limits(), at: tuple[float, ...] = (0.001, 0.01, 0.5, 0.99, 0.999)) -> DataFrame:
    """(up_to, n, ratios): for each length band the ratios at these quantiles, of the texts that pass the base rules."""
    tops = [b[0] for b in limits.bands]
    size = F.octet_length("carried.text")
    band = F.lit(tops[-1])
    for top in reversed(tops[:-1]):
        band = F.when(size <= top, F.lit(float(top))).otherwise(band)
    rows = compression_rules(docs, limits, ("text",)).where("not base_failed")
    return rows.groupBy(band.alias("up_to")).agg(F.count("*").alias("n"), F.percentile_approx("ratio", list(at), 10_000).alias("ratios"))
