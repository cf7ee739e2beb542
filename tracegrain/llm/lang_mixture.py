"""Language identification as inference of a mixture: expectation-maximisation over the words of a document.

Each language has a smoothed model of letter trigrams (hashed to a fixed number of cells, so a model's size is bounded
whatever the corpus: 128 KB a language). A word's likelihood under a language is the product over its letters; a document's words come from a mixture
of languages, whose proportions EM estimates. EM runs until the likelihood is within ``gap`` of its maximum, which the gradient
bounds: no mixture exceeds the present one by more than n * ln(largest mean ratio of a language's likelihood to the mixture's).
The set of languages is chosen by penalised likelihood among the nested sets of the
likeliest ones, of any size: each further language has to earn ``penalty`` * ln(words) / 2. A document whose best single language (or
best set so far) is within that of the bound on any mixture needs no further search, as no larger set can beat it.

The models are learned from all given rows with text and label, with counts summed by Spark. Null texts and texts
without a letter are ``und`` with score 0; very long texts are read whole; repeated rows count as often as they occur, and each row of
the documents, whether it repeats, shares an id or has none, is judged by its own text; with no labelled row all
texts are ``und``; equal likelihoods go to the language first in order; an empty table gives no rows; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import ship_code, slices

CELL_BITS = 15
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]):
    """The cell of the trigram around each letter, where words begin among those, and each text's number of words."""
    whole = "\n".join((x or "").lower().replace("\n", " ") for x in texts)
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    x = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = x[at] * np.uint32(0x9E3779B1) + x[at + 1] * np.uint32(0x85EBCA77) + x[at + 2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    cell = (h >> np.uint32(32 - CELL_BITS)).astype(np.int64)
    starts = np.flatnonzero(x[at] == 0)
    row = np.concatenate([[0], np.cumsum(code == 10)])[at[starts]] if len(code) else np.zeros(0, np.int64)
    return cell, starts, np.bincount(row, minlength=len(texts))[: len(texts)]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # cells x languages


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                cell = trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0]
                sums[lang] = sums.get(lang, 0) + np.bincount(cell, minlength=1 << CELL_BITS)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "cell": pa.array(some.astype(np.int32)), "n": pa.array(n[some])})


def fit(rows: DataFrame) -> Model:
    """Learn from columns text and lang. What comes to the driver is one number for each language and cell."""
    ship_code(rows.sparkSession)
    counts = rows.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))
    n = np.full((1 << CELL_BITS, len(langs)), 0.5)
    n[counts["cell"], np.searchsorted(np.array(langs, object), counts["lang"].to_numpy(object)) if langs else []] += counts["n"]
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32))


def _by_doc(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    at = np.concatenate([[0], np.cumsum(n)])
    return total[at[1:]] - total[at[:-1]]


#: Proportions that change by less than this in a round stand still as far as doubles go.
STILL = 1e-13


def _em(lik: np.ndarray, n: np.ndarray, share: np.ndarray, settled):
    """Proportions of each text's words (``n`` of them, texts one after the other) from these to start with, the
    log-likelihood they give, and how far the maximum can lie above it; until ``settled(texts, likelihood, slack)`` says so, or they stand still."""
    share, seen, slack = share.copy(), np.zeros(len(n)), np.zeros(len(n))
    texts = np.flatnonzero(n)
    lik = lik if len(texts) else lik[:0]
    while len(texts):
        k, own = n[texts], share[texts]
        mix = np.maximum((np.repeat(own, k, axis=0) * lik).sum(axis=1), 1e-30)
        ratio = _by_doc(lik / mix[:, None], k) / k[:, None]
        seen[texts] = _by_doc(np.log(mix)[:, None], k)[:, 0]
        slack[texts] = k * np.log(np.maximum(np.where(own > 0, ratio, 0).max(axis=1), 1))
        done = settled(texts, seen[texts], slack[texts]) | (np.abs(own * ratio - own).max(axis=1) <= STILL)
        share[texts] = np.where(done[:, None], own, own * ratio)
        lik, texts = lik[np.repeat(~done, k)], texts[~done]
    return share, seen, slack


def mixtures(model: Model, texts: list[str | None], gap: float, penalty: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages of each text, and its number of words."""
    cell, starts, n = trigrams(texts)
    k = len(model.langs)
    out = np.zeros((len(texts), k))
    if not len(starts) or not k:
        return out, n
    ll = np.add.reduceat(model.logp[cell], starts, axis=0).astype(np.float64)
    top = ll.max(axis=1, keepdims=True)
    lik = np.exp(np.maximum(ll - top, -60))
    single = _by_doc(np.maximum(ll - top, -60), n)
    value = single.max(axis=1)
    cost = penalty * np.log(np.maximum(n, 2)) / 2
    # All languages: until it is clear whether two of them can be worth it.
    clear = lambda i, seen, slack: (slack <= gap) | (seen + slack - value[i] <= cost[i])
    share, seen, slack = _em(lik, n, np.full((len(texts), k), 1 / k), clear)
    bound = seen + slack
    out[np.arange(len(texts)), single.argmax(axis=1)] = n > 0
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    whose = np.repeat(np.arange(len(texts)), n)
    for size in range(2, min(k, most or k) + 1):
        open_ = np.flatnonzero((n > 0) & (bound - (size - 1) * cost > value))
        if not len(open_):
            break
        start = np.where(rank[open_] < size, np.maximum(share[open_], 1e-6), 0)
        is_open = np.zeros(len(texts), bool)
        is_open[open_] = True
        pi, seen, _ = _em(lik[is_open[whose]], n[open_], start / start.sum(axis=1, keepdims=True), lambda i, seen, slack: slack <= gap)
        worth = seen - (size - 1) * cost[open_]
        better = worth > value[open_]
        out[open_[better]] = pi[better]
        value[open_] = np.maximum(value[open_], worth)
    return out, n


def _predict(model: Model, gap: float, penalty: float, most: int | None):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                share, n = mixtures(model, batch.column("text").to_pylist(), gap, penalty, most)
                known = (n > 0) & bool(model.langs)
                best = share.argmax(axis=1) if model.langs else np.zeros(len(n), int)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.where(known, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0)),
                        pa.array([[{"lang": model.langs[j], "share": float(s[j])} for j in np.flatnonzero(s > 0)] for s in share], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    names=["doc_id", "lang_pred", "score", "mixture"],
                )

    return run


def identify(docs: DataFrame, model: Model, gap: float = 0.05, penalty: float = 4.0, most: int | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of each document; at most ``most`` languages each, as many as were learned if not given."""
    ship_code(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_predict(model, gap, penalty, most), "doc_id long, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
