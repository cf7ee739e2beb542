"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Boosting goes round the features in turn; each step fits a shallow tree on one feature's
bins to the current residuals (Newton steps on the logistic loss, from histograms) and adds its leaf values to that
feature's lookup table. Pairs of features are ranked by how much a two-way split of the residuals gains,
and the best get tables of their own, boosted in the same way. A score is a sum of table entries, one gather for each table.

The model is fitted on at most ``SAMPLE`` labels (pairs of doc_id and label), those with the smallest hash of doc_id; that bound is a
parameter. Scoring covers every row. Null and empty texts have all features zero and get a score like any other; very long
texts are read whole; rows that repeat, share an id or have none are scored each by its own text. A label that repeats counts as often as
it occurs; of several texts with a labelled id the one with the smallest hash teaches; rows whose label or doc_id is null teach
nothing; of splits with equal gains the first is taken; with no labelled row every score is 0.5; an empty table gives no rows;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.compression_rules import _SYMBOL, repeated_words
from tracegrain.llm.shared import _SPACE, ship_code, slices, utf8, word_hashes, words

SAMPLE = 50_000
FEATURES = ["log_words", "word_length", "long_words", "symbols", "punctuation", "upper", "digits", "non_ascii", "lines", "repeats", "distinct", "stop_words", "sentence_length", "bars", "marks", "entropy", "ratio", "capitals", "runs"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_PUNCT, _UPPER, _DIGIT, _STOP, _BAR, _MARK = (_mask(x) for x in (b".,;:'\"()-", bytes(range(65, 91)), b"0123456789", b".?!", b"|", b"!?"))


def features(texts) -> np.ndarray:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    raw, at = utf8(texts)
    n = len(at) - 1
    starts, ends, before = words(raw, at)
    h = word_hashes(raw, starts, ends)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[at])
    by_word = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[before])
    n_words, size = np.diff(before), np.diff(at)
    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    width = ends - starts
    first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    stops = np.maximum(total(_STOP[raw]), 1)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    # Not with the last word of the text before.
    same[before[:-1][n_words > 0]] = False
    distinct, entropy, ratio = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if n_words[i]:
            distinct[i] = len(np.unique(h[before[i] : before[i + 1]])) / n_words[i] ** 0.9
        if size[i]:
            own = raw[at[i] : at[i + 1]]
            p = np.bincount(own, minlength=256)
            p = p[p > 0] / size[i]
            entropy[i] = -(p * np.log2(p)).sum()
            ratio[i] = size[i] / len(z.compress(own.tobytes())) / np.log2(8 + size[i])
    return np.stack(
        [
            np.log2(1 + n_words), by_word_sum(width, before) / w, by_word(width > 12) / w, total(_SYMBOL[raw]) / b, total(_PUNCT[raw]) / b, total(_UPPER[raw]) / b, total(_DIGIT[raw]) / b, total(raw >= 128) / b,
            total(raw == 10) / w, repeated_words(h, before) / w, distinct, by_word(width <= 3) / w, np.minimum(n_words / stops, 200), total(_BAR[raw]) / w, total(_MARK[raw]) / w, entropy, ratio, by_word(_UPPER[first]) / w, by_word(same) / w,
        ],
        axis=1,
    ).astype(np.float32)


def by_word_sum(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[before])


@dataclass(frozen=True)
class Gam:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for own, t in zip(b, self.tables, strict=True):
            f += t[own]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[_coarse(b[i], self.cuts[i]), _coarse(b[j], self.cuts[j])]
        return 1 / (1 + np.exp(-f))


PAIR_BINS = 8


def _coarse(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(cuts) + 1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float) -> np.ndarray:
    """Leaf values of a tree over neighbouring bins with these sums of gradients and curvatures."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if left and b - a > 1:
            gl, hl, gt, ht = gs[:-1], hs[:-1], gs[-1], hs[-1]
            gain = gl**2 / (hl + lam) + (gt - gl) ** 2 / (ht - hl + lam) - gt**2 / (ht + lam)
            k = int(gain.argmax())
            if gain[k] > 1e-9:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = gs[-1] / (hs[-1] + lam)

    grow(0, len(g), depth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """The best cut of a pair's table into four quarters: leaf values and gain."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, len(g)), np.arange(1, len(g)), indexing="ij")
    cells = []
    for a0, a1 in ((np.zeros_like(i), i), (i, np.full_like(i, len(g)))):
        for b0, b1 in ((np.zeros_like(j), j), (j, np.full_like(j, len(g)))):
            cells.append([x[a1, b1] - x[a0, b1] - x[a1, b0] + x[a0, b0] for x in (gs, hs)])
    gain = sum(x**2 / (y + lam) for x, y in cells)
    k = np.unravel_index(gain.argmax(), gain.shape)
    v = [x[k] / (y[k] + lam) for x, y in cells]
    p, q = int(i[k]), int(j[k])
    out = np.empty_like(g)
    out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = v
    return out, float(gain[k] - g.sum() ** 2 / (h.sum() + lam))


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, n_bins: int = 64, depth: int = 2, rate: float = 0.15, lam: float = 5.0) -> Gam:
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return Gam([np.zeros(0)] * k, 0.0, [np.zeros(1)] * k, [], [])
    cuts = [np.unique(np.quantile(x[:, i], np.arange(1, n_bins) / n_bins)) for i in range(k)]
    model = Gam(cuts, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [np.zeros(len(c) + 1) for c in cuts], [], [])
    bins = model.bins(x)
    f = np.full(len(y), model.base)
    for _ in range(rounds):
        for b, t in zip(bins, model.tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), depth, lam)
            t += step
            f += step[b]
    small = [_coarse(b, c) for b, c in zip(bins, cuts, strict=True)]

    def sums(i, j, p):
        at = small[i] * PAIR_BINS + small[j]
        return (np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-f))
    ranked = sorted(((_pair_tree(*sums(i, j, p), lam)[1], i, j) for i in range(k) for j in range(i + 1, k)), key=lambda r: (-r[0], r[1:]))
    for _, i, j in ranked[:n_pairs]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((PAIR_BINS, PAIR_BINS)))
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            step = rate * _pair_tree(*sums(i, j, p), lam)[0]
            t += step
            f += step[small[i], small[j]]
    return model


def _featured(batches):
    for whole in batches:
        for batch in slices(whole):
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("n"), pa.array(features(batch.column("text")).tolist(), pa.list_(pa.float32()))], names=["y", "n", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Learn from labels (doc_id, and a column of 0 and 1) of the documents."""
    ship_code(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id", F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    # At most ``sample`` rows of twenty bytes go to all tasks, and as many rows of features come back.
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = joined.groupBy("doc_id", "y", "n").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("y", "n", "text").mapInArrow(_featured, "y int, n long, x array<float>").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    y, n = rows["y"].to_numpy(float), rows["n"].to_numpy(np.int64)
    order = np.repeat(np.lexsort((n, y, *x.T)), n[np.lexsort((n, y, *x.T))]) if len(rows) else []
    return fit_gam(x[order], y[order])


def _score(model: Gam):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(model.score(features(batch.column("text"))), 0, 1))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) of each document."""
    ship_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
