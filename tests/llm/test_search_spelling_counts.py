"""Spelling variants, reversed search and token counts against plain re-statements, and words that a weak hash confuses."""

import random

import brute
import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tracegrain.llm import compression_rules, decontam, near_dup, quality_gam, queries, reversed_search, spelling, token_counts, tokenise

SF = "/root/testdata/sf0.001"
ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "one"), (None, "word without an id"), (None, None), (9005, "x" * 4000), (9006, "é" * 70 + " " + "日本語 " * 60)]


def frame(spark, rows, schema="doc_id long, text string", n=4):
    return spark.createDataFrame(rows, schema).repartition(n)


def clash(df):
    """Extra columns with names that the operators use inside."""
    return df.withColumns({c: F.lit(c) for c in ("word", "n", "key", "term", "item", "block", "score", "rank", "tie", "part", "left", "right", "copies", "salt")})


def doubled(n):
    """Two words of 2 ** n letters, each the other's mirror: sums over powers of an odd base modulo 2 ** 64 don't tell them apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


# --- spelling variants


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    base = [say(rng.randint(5, 9)) for _ in range(60)]
    out = {}
    for w in base:
        n = rng.choice([5, 6, 25, 30, 150, 800])
        for _ in range(6):
            out[w] = n
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            w = w[:i] + ("" if kind == 0 else rng.choice("abcdé")) + w[i + (kind < 2) :]
            n = rng.choice([5, 5, 6, max(5, n // 5), n])
    return {w: n for w, n in out.items() if len(w) >= 6}


@pytest.mark.parametrize("symbols", [1, 2, 4, 16])
def test_variants(spark, words, symbols, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (symbols,))
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == brute.variants(words)


def test_neighbourhoods_are_full():
    """Each word asks for every word one edit away, whatever symbols its letters are hashed to."""
    rng = random.Random(2)
    keys = lambda make, w: {int(k) for _, key in make([w], 3) for k in key}
    for _ in range(300):
        w = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(6, 9)))
        i, c = rng.randrange(len(w) + 1), rng.choice("abcxyz")
        for x in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]):
            if len(x) >= 6:
                assert keys(spelling.asked, w) & keys(spelling.filed, x)


def test_forms_lead_to_roots(spark):
    """Chains of any length, and ties that go to the first word in code-point order."""
    chain = {"aaaaaa" + "b" * k: 5**k for k in range(1, 9)}
    ties = {"zzzzzzé": 5, "zzzzzzx": 25, "zzzzzzy": 25, "zzzzzz": 24}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([*chain.items(), *ties.items()], "word string, n long")).collect()}
    assert {got[w].root for w in chain} == {"aaaaaabbbbbbbb"} and got["aaaaaabbbbbbbb"].form is None
    assert (got["zzzzzzé"].form, got["zzzzzzé"].form_n, got["zzzzzzé"].n_near) == ("zzzzzzx", 25, 3)
    assert got["zzzzzz"].form is None and got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].n_near == 3


def test_vocabulary(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefÀÿ") for _ in range(rng.randint(4, 10))) for _ in range(150)]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(vocab, k=rng.randint(1, 300)))) for i in range(100)]
    docs += [(3, docs[3][1]), (None, docs[7][1]), (200, "Straße×Œuvre Ÿabcdef naïveté " * 900), (201, "abcdef-ghijkl_mnopqr2stuvwx " * 30), *ODD]
    want = brute.vocabulary(docs)
    assert {r.word: r.n for r in spelling.vocabulary(clash(frame(spark, docs))).collect()} == want and len(want) > 100
    for name, x in (("HELD", 50), ("SLICE", 2000)):
        monkeypatch.setattr(spelling, name, x)
    seen = {}
    import pyarrow as pa

    for b in spelling._count(199, 6)([pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]})]):
        for w, n in zip(*b.to_pydict().values(), strict=True):
            seen[w] = seen.get(w, 0) + n
    assert {w: n for w, n in seen.items() if n >= 5} == want


def test_spelling_on_nothing(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).count() == 0
    assert spelling.variants(spelling.vocabulary(frame(spark, ODD))).count() == 0


def test_vocabulary_is_never_broadcast(spark, words, monkeypatch):
    """Its file is small for what it holds, and a word is filed twice: by the file's size Spark would send both through the driver."""
    plans = []

    def told(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, *rest)

    materialise = spelling.materialise
    monkeypatch.setattr(spelling, "materialise", told)
    out = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    told(out, "out")
    assert sum(x.count("SortMergeJoin") for x in plans) >= 4 and not any("Broadcast" in x for x in plans)


# --- reversed search


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghé1") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, say(rng.choice([1, 3, 20, 200]))) for i in range(150)] + [(300 + i, "the same TEXT, of some words: " + vocab[0]) for i in range(30)]
    docs += [(5, docs[9][1]), (None, docs[4][1]), (400, say(40_000)), *ODD]
    items = [(i, say(rng.randint(1, 12))) for i in range(25)] + [(100, "same text text"), (101, None), (102, "..."), (103, "nowhere zzzzzz"), (2, "other " + vocab[3]), (104, vocab[5] * 1 + " " + vocab[5]), (None, vocab[0])]
    return docs, items


@pytest.mark.parametrize("block_words,cells,exact", [(10**6, 1 << 20, True), (40, 1 << 20, True), (10**6, 60, False)])
def test_search(spark, corpus, monkeypatch, block_words, cells, exact):
    docs, items = corpus
    monkeypatch.setattr(reversed_search, "CELLS", cells)
    items = [*items, (200, " ".join([docs[0][1]] * 3000))] if not exact else items
    rows = frame(spark, [*items, items[0]], "item_id long, text string")
    got = {}
    for r in reversed_search.search(clash(frame(spark, docs)), rows.withColumn("n", F.lit("x")), block_words=block_words).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = {}
    for item, found in brute.search(docs, items):
        want.setdefault(item, []).extend((k, d, s) for k, (d, s) in enumerate(found, 1))
    assert {i: sorted(x, key=repr) for i, x in got.items()} == {i: sorted(x, key=repr) for i, x in want.items() if x}
    assert [d for _, d, _ in sorted(got[100])] == list(range(300, 310))


def test_search_on_nothing(spark, corpus):
    docs, items = (frame(spark, x, s) for x, s in zip(corpus, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert reversed_search.search(docs.limit(0), items).count() == 0
    assert reversed_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert reversed_search.search(docs, items.limit(0)).count() == 0


# --- token counts


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)

    def part():
        k = rng.randrange(9)
        if k < 4:
            return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 10)))
        n = rng.randint(1, 300)
        return [" " * n, "".join(rng.choice("aeiounst") for _ in range(2 * n)), "<|endoftext|>" * rng.randint(1, 3), "".join(rng.choice("日本語😀é'’") for _ in range(n)), rng.choice(["\n", "\n\n  \t", "'re", "'s 've", "1234567890" * rng.randint(1, 40)])][k - 4]

    return [(i, "".join(part() for _ in range(rng.randint(1, 120)))) for i in range(60)]


def test_token_counts(spark, texts, monkeypatch):
    path = queries.tokenizer("byte_bpe_50k.json")
    awkward = [(500, "b" + "a" * 9000), (501, "bb" + "a" * 5001 + " end"), (502, " " * 7000 + "x"), (503, "'" * 4000), (504, "<|endoftext|>" * 700), (505, "ab" * 3000)]
    rows = [*texts, *awkward, texts[0], (None, texts[1][1]), (None, awkward[0][1]), *ODD]
    rounds = []
    counted = token_counts._counted
    monkeypatch.setattr(token_counts, "_counted", lambda *a: rounds.append(a[2:]) or counted(*a))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(clash(frame(spark, rows)), path, chunk=700, overlap=100).collect()), key=repr)
    sizes = [len(x) - 1 for x in brute.encode(path, [t for _, t in rows], 0)]
    assert got == sorted(((d, len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, sizes, strict=True)), key=repr)
    # A run of one letter has its tokens where it begins: chunks that begin elsewhere don't agree, and are widened.
    assert rounds[:2] == [(700, 100), (2800, 400)] and len(rounds) < 5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_whole_texts(spark, texts, name):
    path = queries.tokenizer(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for _, t in texts + ODD]
    else:
        want = [len(x) - 1 for x in brute.encode(path, [t for _, t in texts + ODD], 0)]
    got = token_counts.token_counts(frame(spark, texts + ODD), path).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, n) for (d, _), n in zip(texts + ODD, want, strict=True)), key=repr)


def test_splice_inside_a_word():
    """One word of half a million letters: no pair of its chunks has a boundary between words, and all splice."""
    path = queries.tokenizer("byte_bpe_50k.json")
    tok, rng = tokenise._load(path)[0], random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(500_000))
    encs = [tok.encode(text[i : i + 16384], add_special_tokens=False) for i in range(0, len(text) - 512, 16384 - 512)]
    total = sum(len(e.ids) for e in encs)
    for a, b in zip(encs[:-1], encs[1:], strict=True):
        ahead, behind = token_counts.boundaries(a, 16384 - 512, 16384 - 21), token_counts.boundaries(b, 1, 512)
        ahead[0] -= 16384 - 512
        at = token_counts.splice(ahead, behind, token_counts._pairs_of(path))
        total -= len(a.ids) - at[0] + at[1]
    assert total == len(tok.encode(text, add_special_tokens=False).ids)


def test_token_counts_on_nothing(spark):
    assert token_counts.token_counts(frame(spark, []), queries.tokenizer("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(frame(spark, []), queries.tokenizer("byte_bpe_50k.json"), chunk=10, overlap=9)


def test_very_long_text(spark):
    """Texts of two megabytes: every word counted, found and tokenised."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(6, 9))) for _ in range(500)]
    docs = [(1, " ".join(rng.choice(vocab) for _ in range(250_000))), (2, "short " + vocab[0]), (3, "z" * 100_000 + " " + vocab[1])]
    rows = frame(spark, docs)
    assert {r.word: r.n for r in spelling.vocabulary(rows).collect()} == brute.vocabulary(docs)
    items = [(1, vocab[0] + " short"), (2, " ".join(vocab))]
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in reversed_search.search(rows, frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(i, k): x for i, found in brute.search(docs, items) for k, x in enumerate(found, 1)}
    path = queries.tokenizer("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, path).collect()} == {d: len(x) - 1 for (d, _), x in zip(docs, brute.encode(path, [t for _, t in docs], 0), strict=True)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""


# --- words that a weak hash confuses


def test_words_made_by_doubling(spark):
    import pyarrow as pa

    from tracegrain.llm.shared import utf8, word_hashes
    from tracegrain.llm.shared import words as split

    for n in range(1, 14):
        raw, at = utf8(pa.array([" ".join(doubled(n))]))
        assert len(set(word_hashes(raw, *split(raw, at)[:2]).tolist())) == 2
    a, b = doubled(10)
    twelve = f"one two {a} three four five six {b} seven eight nine ten"
    docs = [(1, a), (2, b), (3, twelve), (4, twelve.replace(a, "x").replace(b, a)), (5, " ".join([f"{a} p q {b} p q"] * 1 + [f"w{i}" for i in range(60)])), (6, a)]
    near = brute.near(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, docs)).collect()} == near and near[2][2] and near[3][0] == 8
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in compression_rules.compression_rules(frame(spark, docs)).collect()}
    assert got == {d: brute.base_rules(t) for d, t in docs} and got[5][4] == 0
    items = [(1, a), (2, "three four five six " + b)]
    found = decontam.report(decontam.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string")))
    assert {tuple(r) for r in found.collect()} == {(d, *x) for d, x in brute.contamination(docs, items).items()}
    x = quality_gam.features(pa.array([f"{a} {b}", f"{a} {a}"]))
    at = quality_gam.FEATURES.index("distinct")
    assert not np.isclose(x[0, at], x[1, at])


def test_upper_bound_loses_no_pair():
    """What the cells' counts allow is never less than what two sets have in common, in sets of any size, and it tells most others apart."""
    import pyarrow as pa

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocab, k=600)
    texts = [" ".join(base)] + [" ".join(rng.choice(vocab) if rng.random() < p else w for w in base) for p in (0.01, 0.03, 0.05, 0.2, 0.5)] + [" ".join(rng.choices(vocab, k=600)), " ".join(rng.choices(vocab, k=200_000))]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    counts = [np.frombuffer(x, np.uint8).astype(int) for b in near_dup._cells([batch]) for x in b.column("more").to_pylist()]
    sets = [brute.shingle_set(t) for t in texts]
    for i, a in enumerate(sets[:-1]):
        for j, b in enumerate(sets[:-1]):
            most = int(np.minimum(counts[i], counts[j]).sum())
            assert most >= len(a & b) and (i == j or len(a & b) > 0.5 * len(a) or 100 * most < 75 * (len(a) + len(b) - most))
    # A set that fills the cells is told nothing about.
    assert counts[-1].min() == 255


def test_a_hub_is_dealt_out(spark):
    """The partners of one hub meet it in many parts, its text once in each; links are those of the full sets."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    texts = [(0, " ".join(base))] + [(i, " ".join(rng.choice(base) if rng.random() < 0.05 * (i % 4) else w for w in base)) for i in range(1, 1500)]
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 1500)] + [(0, 1)], "a long, b long").repartition(3)
    seen = []
    held = near_dup._confirm
    try:
        near_dup._confirm = lambda percent: lambda batches: (b.select(["a", "b"]) for b in batches)
        seen = near_dup.confirm(pairs, frame(spark, texts, "id long, text string"), 75).where("b = 0").collect()
    finally:
        near_dup._confirm = held
    assert 200 < sum(r.a is None for r in seen) <= near_dup.PARTS and len(seen) - sum(r.a is None for r in seen) == 1499
    sets = {i: brute.shingle_set(t) for i, t in texts}
    close = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    got = {(r.a, r.b) for r in near_dup.confirm(pairs, frame(spark, texts, "id long, text string"), 75).collect()}
    assert got == {(i, 0) for i in range(1, 1500) if close(i, 0)} | ({(0, 1)} if close(0, 1) else set()) and 300 < len(got) < 1400


def test_long_items_are_cut(spark):
    """An item of more words than a block: its pieces have its windows, and spans are the same as with one block."""
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(300)]
    item = [rng.choice(vocab) for _ in range(500)]
    items = [(1, " ".join(item)), (2, "alpha beta gamma"), (3, None), (4, " ".join(item[100:130]) + " end")]
    docs = [(i, " ".join(rng.choices(vocab, k=10) + item[k : k + rng.randint(8, 60)] + rng.choices(vocab, k=5))) for i, k in enumerate(range(0, 490, 7))] + [(900, " ".join(item)), (901, "ALPHA, beta. gamma!")]
    frames = frame(spark, docs), frame(spark, items, "item_id long, text string")
    found = {}
    for most in (10**6, 90, 33):
        assert most > 10**5 or all(len(t.split()) <= most + 9 for x in decontam.blocks(frames[1], most, 10) for t in x["text"].fillna(""))
        rows = decontam.decontaminate(*frames, block_words=most)
        found[most] = {r.doc_id: (r.n_words, [(x.start, x.stop) for x in r.spans], sorted(r["items"])) for r in rows.collect()}
        assert {tuple(r) for r in decontam.report(rows).collect()} == {(d, *x) for d, x in brute.contamination(docs, items).items()}
    assert found[90] == found[33] == found[10**6]
