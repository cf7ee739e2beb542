"""Features of the learned operators by plain loops, and every operator on a text of two megabytes."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import chat_collapse, compression_rules, hilbert_pack, lang_mixture, quality_gam, queries, token_store, url_trees

TEXTS = [None, "", " \n\t ", "one", "Two WORDS, and 3 more! a a a", "a | b | c\n\nd | e ?! Ünïcödé 日本語 naïve", "x" * 3000, "the cat sat on the mat. the cat sat on the hat! " * 30, "".join(chr(c) for c in range(32, 127)) * 3]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def plain_features(text):
    """The nineteen features of one text, from characters and words."""
    import zstandard

    text = text or ""
    raw, w = text.encode(), [x.encode() for x in brute.SPACE.findall(text)]
    n, size = max(len(w), 1), max(len(raw), 1)
    of = lambda chars: sum(b in chars for b in raw)
    entropy = -sum(k / len(raw) * math.log2(k / len(raw)) for k in Counter(raw).values())
    return [
        math.log2(1 + len(w)), sum(map(len, w)) / n, sum(len(x) > 12 for x in w) / n, of(b"#*$%&|<>") / size, of(b".,;:'\"()-") / size, sum(65 <= b <= 90 for b in raw) / size, sum(48 <= b <= 57 for b in raw) / size, sum(b >= 128 for b in raw) / size,
        of(b"\n") / n, brute.base_rules(text)[4] / n, len(set(w)) / n**0.9, sum(len(x) <= 3 for x in w) / n, min(len(w) / max(of(b".?!"), 1), 200), of(b"|") / n, of(b"!?") / n, entropy,
        len(raw) / len(zstandard.ZstdCompressor(level=1).compress(raw)) / math.log2(8 + len(raw)) if raw else 0, sum(65 <= x[0] <= 90 for x in w) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
    ]


def test_quality_features():
    import pyarrow as pa

    got = quality_gam.features(pa.array(TEXTS, pa.string()))
    want = np.array([plain_features(t) for t in TEXTS])
    # A word that repeats from one text into the next would count there: the texts are laid end to end.
    assert got.shape == (len(TEXTS), len(quality_gam.FEATURES)) and np.allclose(got, want, rtol=1e-5, atol=1e-6)
    again = quality_gam.features(pa.array(["same", "same same"], pa.string()))
    assert np.allclose(again[:, -1], [0, 0.5])


URLS = [None, "", "no scheme", "http://a.b", "https://www.Example.COM/en/x1/y-2?a=1&b=2;c#frag", "ftp://h-o-s-t.co.uk/", "http://x.net?q=1", "http://1.2.3.4/p/99/", "https://ü.de/ä?ö#ß", "http://a..b/c//d"]


def plain_lexical(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = brute.fold(re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
    query = re.search(r"\?([^#]*)", url)
    digits = lambda s: len(re.findall("[0-9]", s)) / max(len(s), 1)
    labels = host.split(".")
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "labels": len(labels), "depth": len(path.split("/")), "digits": digits(url), "entropy": -sum(k / len(url) * math.log2(k / len(url)) for k in Counter(url).values()),
        "params": len(re.split("[&;]", query[1] if query else "")), "hyphens": host.count("-"), "has_www": int(host.startswith("www.")), "path_digits": digits(path), "has_fragment": int("#" in url), "https": int(url.startswith("https")), "top": labels[-1], "suffix": ".".join(labels[-2:]),
    }


def test_url_features(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    host, path = url_trees.split_url(F.col("url"))
    got = {r.page_id: r.asDict() for r in url_trees.lexical(pages.select("page_id", "url", host.alias("host"), path.alias("path"))).collect()}
    for i, url in enumerate(URLS):
        for name, want in plain_lexical(url).items():
            assert got[i][name] == (pytest.approx(want, abs=1e-12) if isinstance(want, float) else want), (url, name)


def test_suffix_rates(spark):
    """A labelled row's rate leaves its own fold out; one without a label has all folds'."""
    data = [("a", 0, 1.0)] * 4 + [("a", 1, 0.0)] * 2 + [("b", 0, 1.0)] + [("a", -1, None)]
    got = {(r.key, r.fold): r.rate for r in url_trees._rates(spark.createDataFrame(data, "key string, fold long, label double"), "key", "rate", 0.5, 20.0).collect()}
    want = {("a", 0): (0 + 10) / 22, ("a", 1): (4 + 10) / 24, ("a", -1): (4 + 10) / 26, ("b", 0): 0.5, ("b", -1): 11 / 21}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def plain_cell(before, own, behind):
    x = [ord(c) if c.isalpha() else 0 for c in (before, own, behind)]
    h = (x[0] * 0x9E3779B1 + x[1] * 0x85EBCA77 + x[2] * 0xC2B2AE3D) % 2**32
    h ^= h >> 15
    return (h * 0x2C1B3C6D % 2**32) >> (32 - lang_mixture.CELL_BITS)


def plain_trigrams(text):
    padded = f" {(text or '').lower()} "
    return [plain_cell(*padded[i - 1 : i + 2]) for i in range(1, len(padded) - 1) if padded[i].isalpha()]


def test_trigram_counts(spark):
    """What a model learns: how often each cell occurs in each language's texts, each text by itself."""
    texts = [*TEXTS, "ab", "cd", "İstanbul DŽ ß", "it's e-mail x2y"]
    langs = ["en", "de", None]
    data = [(langs[i % 3], t) for i, t in enumerate(texts)]
    model = lang_mixture.fit(spark.createDataFrame(data, "lang string, text string").repartition(3))
    counts = {"en": Counter(), "de": Counter()}
    for lang, t in data:
        if lang and t is not None:
            counts[lang].update(plain_trigrams(t))
    assert model.langs == ("de", "en")
    for j, lang in enumerate(model.langs):
        n = np.full(1 << lang_mixture.CELL_BITS, 0.5)
        for cell, k in counts[lang].items():
            n[cell] += k
        assert np.allclose(model.logp[:, j], np.log(n / n.sum()), atol=1e-5)


def test_boosting_recovers_a_sum():
    """Labels from a sum of two curves and a product: the model tells them apart, and needs its pair for the product."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (6000, 4))
    z = 3 * np.sin(3 * x[:, 0]) + 4 * np.abs(x[:, 1]) - 2
    y = (rng.uniform(size=len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    model = quality_gam.fit_gam(x[:4000], y[:4000])
    best = 1 / (1 + np.exp(-z[4000:]))
    loss = lambda p: -(y[4000:] * np.log(p) + (1 - y[4000:]) * np.log(1 - p)).mean()
    assert loss(np.clip(model.score(x[4000:]), 1e-6, 1 - 1e-6)) < loss(best) + 0.03 < loss(np.full(2000, y.mean())) - 0.1
    odd = (x[:, 2] * x[:, 3] > 0).astype(float)
    pair = quality_gam.fit_gam(x[:4000], odd[:4000])
    assert (2, 3) in pair.pairs and ((pair.score(x[4000:]) > 0.5) == (odd[4000:] > 0.5)).mean() > 0.9


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    return " ".join(rng.choice(vocab) for _ in range(330_000))


def test_two_megabytes(spark, long_text):
    """Language, tokens, packing, quality and conversations of a very long text are those of the whole."""
    assert len(long_text) > 2 << 20
    texts = [long_text, "çàrrû zéßt wxýz " * 40, long_text[:1000]]
    docs = rows(spark, texts)
    model = lang_mixture.fit(docs.withColumn("lang", F.when(F.col("doc_id") == 1, "b").otherwise("a")))
    assert {r.doc_id: r.lang_pred for r in lang_mixture.identify(docs, model).collect()} == {0: "a", 1: "b", 2: "a"}
    path = queries.tokenizer("byte_bpe_50k.json")
    ids = brute.encode(path, texts, 2)
    stored = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(*token_store.write_tokens(docs, path, 2)).collect()}
    assert stored == {i: (len(x), brute.crc(x)) for i, x in enumerate(ids)}
    path = queries.tokenizer("word_bpe_49k.json")
    pieces = hilbert_pack.pack(docs, path, 1).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert {r.doc_id: (r.n, r.whole) for r in pieces} == {i: (len(x), len(x)) for i, x in enumerate(brute.encode(path, texts, 1))}
    import pyarrow as pa

    assert np.allclose(quality_gam.features(pa.array(texts)), [plain_features(t) for t in texts], rtol=1e-4)
    assert quality_gam.score(docs, quality_gam.fit_gam(np.zeros((0, 19)), np.zeros(0))).count() == 3
    turns = spark.createDataFrame([(1, 0, "user", long_text), (2, 0, "user", long_text), (2, 1, "bot", "yes"), (3, 0, "user", long_text[:-1])], "conv_id long, turn int, role string, text string")
    kept = {r.conv_id: len(r.rendered) for r in chat_collapse.render(turns).collect()}
    assert set(kept) == {2, 3} and min(kept.values()) > len(long_text)


def test_two_megabytes_of_url(spark):
    """A url of two megabytes: host and path are found in the whole of it."""
    pages = spark.createDataFrame([(1, "http://Example.com/en/" + "x" * (2 << 20) + "?q#f"), (2, "http://a.net/es/1"), (3, "http://b.com/")], "page_id long, url string")
    got = {r.page_id: r for r in url_trees.judge(pages, queries.URL_RULES).collect()}
    assert (got[1].host, len(got[1].path), got[1].verdict) == ("example.com", 4 + (2 << 20), "block") and got[2].verdict == "block" and got[3].verdict == "allow"


def test_stages_on_two_megabytes(spark, long_text):
    """Every stage reads a very long text whole; a passage at its end counts."""
    import corpus_pipeline as p

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 80").first().text
    rng = random.Random(1)
    tail = " ".join("".join(rng.choices("etaoinshr", k=6)) for _ in range(40))
    texts = [long_text + " " + tail, long_text + " other", tail + " " + bench, "few words"]
    docs = rows(spark, texts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    of = lambda name, d: {r.doc_id: r.text for r in dict(p.STAGES)[name](spark, d, "/root/testdata/sf0.001").collect()}
    assert set(of("quality_rules", docs)) == {i for i, t in enumerate(texts) if brute.compression(t, compression_rules.Limits())[0]}
    assert set(of("near_duplicates", docs)) == {0, 2, 3}
    cut = of("repeated_passages", docs)
    assert cut[0] == texts[0] and len(cut[1]) < 120 and tail not in cut[2] and cut[3] == texts[3]
    assert set(of("benchmark_free", docs)) == {0, 1, 3}
    packed = {r.doc_id: r.n for r in p.packing(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == {i: len(x) for i, x in enumerate(brute.encode(queries.tokenizer("word_bpe_49k.json"), texts, 1))} and zlib.crc32(b"") == 0
