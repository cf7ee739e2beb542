"""The training-data operators against plain re-statements, on small inputs with awkward rows."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import chat_collapse, compression_rules, decontam, hilbert_pack, lang_mixture, near_dup, quality_gam, queries, suffix_dedup, token_store, tokenise, url_trees

SF = "/root/testdata/sf0.001"
ODD = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "one"), (9004, "one two three"), (9005, "x" * 4000), (9006, "é" * 70 + " " + "日本語 " * 60), (9007, "a b c d e f g h i j k l " * 40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(40)
    docs = [(i, say(rng.randint(1, 160))) for i in range(60)]
    docs += [(100 + i, say(rng.randint(3, 30)) + " " + passage + " " + say(rng.randint(0, 30))) for i in range(300)]
    base = say(150).split()
    for i in range(60):  # near copies, some at the threshold
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((500 + i, " ".join(w)))
    docs += [(700 + i, docs[5][1]) for i in range(10)]
    return docs + ODD


def frame(spark, rows, schema="doc_id long, text string", n=4):
    return spark.createDataFrame(rows, schema).repartition(n)


def clash(df):
    """Extra columns with names that the operators use inside."""
    return df.withColumns({c: F.lit(c) for c in ("mini", "key", "spans", "score", "kind", "ids", "id", "n")})


def test_suffix(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_array_dedup(clash(frame(spark, texts)), keep_text=False).collect()}
    assert got == brute.suffix(texts)


def test_suffix_repeated_and_null_ids(spark):
    """Rows that repeat lose nothing to each other; rows that share an id, or have none, are cut each by its own spans."""
    import corpus_pipeline

    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    twice, inner, other, passage = say(400), say(150), say(300), say(200)
    rows = [(1, twice)] * 3 + [(2, inner + say(50) + inner)] * 2 + [(3, passage), (4, other), (4, say(90) + passage + say(70))]
    rows += [(None, say(30) + passage), (None, say(500)), (None, None), (None, None)]
    # Each distinct row as a document of its own: ids in order, then those without one.
    own = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))}
    want = brute.suffix([(i, r[1]) for r, i in own.items()])
    docs = frame(spark, rows)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_array_dedup(clash(docs)).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order([(r[0], *want[own[r]]) for r in rows])
    assert {r[2] for r in got if r[0] == 1} == {0} and {r[2] for r in got if r[0] == 2} == {150}
    more = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = corpus_pipeline.repeated_passages(spark, more, SF).collect()
    assert len(kept) == len(rows) and [r.text for r in kept if r.doc_id == 1] == [twice] * 3


def _steps(docs, window=100, buckets=16):
    """The stages of suffix_dedup in this process: each text's number of bytes and of those removed, the runs that each
    bucket meets, and how many texts each group has."""
    from collections import Counter, defaultdict

    batch = lambda rows: pa.RecordBatch.from_pydict({"doc": [d for d, _ in rows], "tie": [0] * len(rows), "text": [t for _, t in rows]})
    cut, met, segs, spans, sizes, texts = defaultdict(list), [], defaultdict(list), [], [], Counter()
    rows = lambda batches: [r for b in batches for r in b.to_pylist()]
    some = len(docs) * 9 // 10
    for part in (docs[:some], docs[some:]):
        for b in suffix_dedup._cut(window, buckets)([batch(part)]):
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                cut[one.column("bucket")[0].as_py() if one.column("kind")[0].as_py() else -1].append(one)
    for own in cut.values():
        sizes.append(sum(len(x) for x in (r["payload"] or b"" for r in rows(own))) // 40)
        met += rows(suffix_dedup._meet(window)(own))
    asked = defaultdict(list)
    for r in met:
        if r["kind"]:
            asked[r["doc"]].append({k: r[k] for k in ("start", "stop", "mini", "lead", "kind")})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("mini", pa.int64()), ("lead", pa.int32()), ("kind", pa.int32())]))
    for i in range(0, len(docs), 500):
        mine = [x for x in docs[i : i + 500] if x[0] in asked]
        for b in suffix_dedup._fetch(window, buckets)([batch(mine).append_column("asked", pa.array([asked[d] for d, _ in mine], kind))]):
            for j in range(b.num_rows):
                one = b.slice(j, 1)
                r = one.to_pylist()[0]
                segs[r["bucket"]].append(one)
                texts[r["mini"]] += r["seg"] is not None and r["start"] >= 0
    spans = [r for r in met if not r["kind"]] + [r for own in segs.values() for r in rows(suffix_dedup._search(window)(own))]
    gone = defaultdict(set)
    for r in spans:
        gone[r["doc"]].update(range(r["start"], r["stop"]))
    return {d: (len(t), len(gone[d])) for d, t in docs}, sizes, max(texts.values(), default=0)


@pytest.mark.parametrize("many,most,spread", [(1, 3, 10**9), (1, 10**9, 10**9), (1, 2, 20), (10**9, 10**9, 10**9)])
def test_suffix_hot_lines(monkeypatch, many, most, spread):
    """Lines below and above a window's size in ever different contexts: by class, by window, and by window in one part only."""
    rng = random.Random(11)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines, ends = (say(85), say(70), say(130)), [say(30) for _ in range(4)]
    docs = [(i, say(40) + rng.choice(ends) + rng.choice(lines) + rng.choice(ends) + say(40)) for i in range(200)]
    for name, x in (("MANY", many), ("MOST", most), ("SPREAD", spread)):
        monkeypatch.setattr(suffix_dedup, name, x)
    assert _steps(docs)[0] == {d: x[:2] for d, x in brute.suffix(docs).items()}


@pytest.mark.parametrize("spread", [512, 10**9])
def test_suffix_hot_line_is_dealt_out(monkeypatch, spread):
    """A line of 80 bytes in 5,000 contexts: no group of texts and, if it shows in one task, no bucket of runs holds them all."""
    rng = random.Random(12)
    line = "".join(rng.choice("abcdefgh ") for _ in range(80))
    docs = [(i, rng.randbytes(30).hex() + line + rng.randbytes(30).hex()) for i in range(5000)]
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    got, sizes, texts = _steps(docs)
    assert got == {d: x[:2] for d, x in brute.suffix(docs).items()}
    assert texts <= suffix_dedup.MOST and (spread > 512 or max(sizes) < 2 * sum(sizes) / 16)


def test_interval_expansion():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[2000:2300] = text[100:400]
    text[-1] = 0xFF
    t = suffix_dedup.Transform(text, 40)
    raw = text.tobytes()
    want = [True] + [raw[a : a + 40] != raw[b : b + 40] for a, b in zip(t.order[:-1], t.order[1:], strict=True)]
    assert t.expand().tolist() == want


def test_near(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(clash(frame(spark, texts))).collect()}
    assert got == brute.near(texts)


def test_near_by_rows(spark):
    """Rows that repeat, share an id or have none: each is judged by its own text, and one row of each component is first."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    a, b, c = say(100), say(100), say(100)
    near = a + " tail"
    rows = [(1, a), (1, a), (1, b), (2, near), (3, b), (None, near), (None, c), (None, c), (4, c), (None, say(60)), (None, None), (None, ""), (None, "")]
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(clash(docs)).collect()), key=repr)
    want = [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (None, 1, False)] + [(None, 4, False)] * 2 + [(4, 4, True)] + [(None, None, True)] * 4
    assert got == sorted(want, key=repr)
    kept = sorted(((r.doc_id, r.text, r.extra) for r in near_dup.drop_near_duplicates(docs.withColumn("extra", F.lit(7))).collect()), key=repr)
    assert kept == sorted([(1, a, 7), (1, b, 7), (4, c, 7), (None, rows[9][1], 7), (None, None, 7), (None, "", 7), (None, "", 7)], key=repr)


def test_near_hot_key_in_blocks(spark, monkeypatch, texts):
    """Many texts with half of their words in common, none near another, and some near copies: same result in blocks of any size."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    common = say(120)
    docs = [(i, common + " " + say(40)) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " x") for i in range(20)]
    want = brute.near(docs)
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    members = spark.createDataFrame([(1, i, 40) for i in range(40)], "key long, id long, count long")
    groups = near_dup.in_blocks(members, 16).groupBy("key", "lo", "hi").agg(F.collect_list("id").alias("ids"), F.collect_set("part").alias("parts")).collect()
    met = [(x, y) for g in groups for x in g.ids for y in g.ids if x < y]
    assert len(groups) == 6 and {(x, y) for x, y in met} == {(x, y) for x in range(40) for y in range(x + 1, 40)}
    monkeypatch.setattr(near_dup, "ROUNDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (50, 60), (70, 71)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 50: 40, 60: 40, 70: 70, 71: 70}


def test_rules(spark, texts):
    got = {r.doc_id: r for r in compression_rules.compression_rules(clash(frame(spark, texts))).collect()}
    for doc, text in texts:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text)
        assert (r.kept, r.n_chunks, r.n_odd_chunks) == brute.compression(text, compression_rules.Limits()), doc
    assert got[150].kept and not got[9005].kept


def test_tail_of_a_text_is_judged(spark):
    """A text of prose whose end is noise: the chunk that ends with the text is odd, whatever the length of the rest."""
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(n))
    one = " ".join(say(900).split(" "))[:4096]
    docs = [(1, one), (2, one[:4000] + "ab" * 2000), (3, one + one[::-1]), (4, one[:-1])]
    got = {r.doc_id: r for r in compression_rules.compression_rules(frame(spark, docs), carry=("text",)).collect()}
    assert [got[i].n_chunks for i in (1, 2, 3, 4)] == [1, 2, 2, 0] and got[2].n_odd_chunks == 1 and not got[2].kept
    assert all((got[d].kept, got[d].n_chunks, got[d].n_odd_chunks) == brute.compression(t, compression_rules.Limits()) and got[d].carried.text == t for d, t in docs)


def test_bands_follow_length(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(900))
    docs = [(1, prose), (2, " ".join(f"{x}{i % 7}" for i, x in enumerate(["alpha beta gamma delta"] * 600))), (3, " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(400)))]
    got = {r.doc_id: r.kept for r in compression_rules.compression_rules(frame(spark, docs)).collect()}
    assert got[1] and not got[2]


def test_decontamination(spark, texts):
    items = [(i, " ".join(texts[100 + i][1].split()[:25])) for i in range(8)] + [(90, "One two"), (91, None), (92, ""), (93, "a b c d e f g h i j k l m"), (95, "ONE"), (93, "x y z")]
    bench = frame(spark, items, "item_id long, text string", 2)
    want = brute.contamination(texts, items)
    for words in (decontam.BLOCK_WORDS, 60):
        found = decontam.report(decontam.decontaminate(clash(frame(spark, texts)), bench, block_words=words))
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()} == want
    none = decontam.report(decontam.decontaminate(frame(spark, texts), bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_decontamination_repeated_rows(spark):
    """One block or several: repeated items count once, and each row of the documents keeps a row of its own."""
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    items = [(1, a)] * 40 + [(1, b), (2, a), (3, "nothing of this is in any of the documents here")]
    docs = [(5, f"x {a} y {b}"), (5, f"x {a} y {b}"), (5, "clean"), (6, b), (None, a), (None, a), (None, "clean")]
    bench = frame(spark, items, "item_id long, text string", 2)
    assert sum(len(x) for x in decontam.blocks(bench)) == sum(len(x) for x in decontam.blocks(bench, 10)) == 4
    own = list(dict.fromkeys(docs))
    found = brute.contamination([(i, t) for i, (_, t) in enumerate(own)], items)
    want = sorted(((d, *found[own.index((d, t))]) for d, t in docs), key=repr)
    for words in (decontam.BLOCK_WORDS, 10):
        got = decontam.report(decontam.decontaminate(frame(spark, docs), bench, block_words=words)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == want


@pytest.mark.parametrize("name,design", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "ended")])
def test_chunks_equal_whole_texts(name, design, texts):
    odd = ["  ", " a", "a ", "\n\n x  y\n", "It's  ok, isn't it?x\x01y \x01 z", "a\x01", " '\x01s", "<|endoftext|> a", "tab\there\r\nnew line", "x.'s y,'ll a.b,c.", "123 4,567.89 ½ ²", "ΑΣ ΟΔΟΣ. İ", "a\n b", "a \nb", "foo\x1cbar \x1c baz", "x́ , ́."]
    odd += ["x <|endoftext|> y", "x <|EndOfText|>y<|startoftext|>", "<|endoftext|>", "a<|end|>b", "don't 'll 'lla y'all's 'S", "(one) [two]-three_four ''five''", "a\n\nb\n c\n\n\nd", "\nx\ny", "a\xa0 b\u3000\n c", "h\u0331 H\u0331, e\u0301.", "é,è!×,÷.ÿ;Ā,ſ.", "x" * 70_000 + " y", "word$$$ ***word -- a--b"]
    some = odd + [t for _, t in texts[:40] + texts[-8:]]
    tok = tokenise.Chunks(queries.tokenizer(name))
    assert tok.design == design
    for same in range(2):
        ids, n = tok.ids(pa.array(some, pa.string()))
        at = np.concatenate([[0], np.cumsum(n)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x[:-1] for x in brute.encode(queries.tokenizer(name), some, 0)], same


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_of_random_texts(name):
    """Strings of awkward characters, one to sixteen long, against the library; twice with next to nothing remembered."""
    rng = random.Random(4)
    marks = [*"aZé' \n\t.,$<|>_09-!\"", "İ", "ſ", "\u0301", "\xa0", "\u2003", "\x1c", "\x85", "日", "—", "×", "'s", "'re", "  ", "the", " of", "Straße", "ΟΔΟΣ", "½", "<|endoftext|>", "\r\n"]
    some = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    want = brute.encode(queries.tokenizer(name), some, 0)
    tok = tokenise.Chunks(queries.tokenizer(name))
    for i in range(0, len(some), 5000):
        ids, n = tok.ids(pa.array(some[i : i + 5000]))
        at = np.concatenate([[0], np.cumsum(n)])
        for j in range(len(n)):
            assert ids[at[j] : at[j + 1]].tolist() == want[i + j][:-1], repr(some[i + j])
        if i % 10_000:
            tok.held = tokenise.REMEMBER + 1
        else:
            tok.rest()


def test_what_a_worker_keeps(monkeypatch):
    tok = tokenise.Chunks(queries.tokenizer("byte_bpe_50k.json"))
    for t in ("one two three", "zero two, three", "no three"):
        tok.ids(pa.array([t]))
    tok.rest()
    assert set(tok.known) == {" two", " three"} and tok.ids(pa.array(["a two three"]))[0].tolist() == brute.encode(queries.tokenizer("byte_bpe_50k.json"), ["a two three"], 0)[0][:-1]
    tok.rest()
    monkeypatch.setattr(tokenise, "KEEP", 0)
    tok.rest()
    assert not tok.known and not tok.held


def test_other_designs_go_whole(tmp_path):
    import json

    path = queries.tokenizer("byte_bpe_50k.json")
    spec = json.load(open(path, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = str(tmp_path / "other.json")
    json.dump(spec, open(other, "w", encoding="utf-8"))
    tok = tokenise.Chunks(other)
    some = ["a b, c", None, "", " d\n\ne"]
    ids, n = tok.ids(pa.array(some))
    assert tok.design == "unknown" and ids.tolist() == [x for y in brute.encode(other, some, 0) for x in y[:-1]] and n.tolist()[1:3] == [0, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stops_behind_letters_beyond_ascii(name):
    some = ["LİSESİ, LİSESİ. LİSESİ", "İ, İ.", "ﬁ, ŉ. ǰ, ΐ. ΟΔΟΣ, straße. ẞ, École, DŽ, ÅNGSTRÖM. Å,", "Ends, with. plain words, Too."]
    tok = tokenise.Chunks(queries.tokenizer(name))
    for text in some:
        assert tok.ids(pa.array([text]))[0].tolist() == brute.encode(queries.tokenizer(name), [text], 0)[0][:-1], text


def test_codec_round_trip():
    x = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(x) + 1):
        assert token_store.decode(*token_store.encode(x[:n]), n).tolist() == x[:n].tolist()


def test_store(spark, texts):
    path = queries.tokenizer("byte_bpe_50k.json")
    blocks, ranks = token_store.write_tokens(clash(frame(spark, texts)), path, 2)
    want, at = {}, 0
    docs = sorted(texts)
    for (doc, _), ids in zip(docs, brute.encode(path, [t for _, t in docs], 2), strict=True):
        want[doc] = (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(blocks, ranks).collect()} == want


def test_pack(spark, texts):
    path = queries.tokenizer("word_bpe_49k.json")
    rows = hilbert_pack.pack(clash(frame(spark, texts)), path, 1, length=256, keep_ids=True).collect()
    whole = dict(zip((d for d, _ in texts), brute.encode(path, [t for _, t in texts], 1), strict=True))
    pieces, places = {}, {}
    for r in rows:
        assert r.ids_crc32 == brute.crc(r.ids) and r.doc_tokens == len(whole[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in pieces.items():
        assert [x for _, ids in sorted(own) for x in ids] == whole[doc]
    assert set(pieces) == set(whole)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= 256 and total & (total - 1) == 0


def test_hilbert_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_pack.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_mixture.fit(docs.where(~queries._held_out()))
    got = lang_mixture.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries._held_out())
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in lang_mixture.identify(clash(frame(spark, ODD)), model).collect()}
    assert odd[9000] == odd[9001] == odd[9002] == ("und", 0.0)
    first = {r.lang: r.text for r in docs.collect()}
    mixed = lang_mixture.identify(frame(spark, [(1, first["en"][:900] + " " + first["fr"][:900])]), model).first()
    assert {x.lang for x in mixed.mixture} == {"en", "fr"}
    assert lang_mixture.identify(frame(spark, ODD), lang_mixture.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_sets_have_no_limit():
    """Six languages in one text, each with letters of its own; a limit holds only if it is given."""
    rng = random.Random(5)
    say = lambda i, n: " ".join("".join(rng.choice(chr(97 + 4 * i) + chr(98 + 4 * i) + chr(99 + 4 * i)) for _ in range(5)) for _ in range(n))
    counts = np.stack([np.bincount(lang_mixture.trigrams([say(i, 3000)])[0], minlength=1 << lang_mixture.CELL_BITS) + 0.5 for i in range(6)], axis=1)
    model = lang_mixture.Model(tuple("abcdef"), np.log(counts / counts.sum(axis=0)).astype(np.float32))
    predict = lang_mixture.identify.__defaults__
    share, n = lang_mixture.mixtures(model, [" ".join(say(i, 60) for i in range(6))], *predict)
    assert n.tolist() == [360] and np.allclose(share, 1 / 6, atol=0.02)
    assert (lang_mixture.mixtures(model, [" ".join(say(i, 60) for i in range(6))], *predict[:-1], 4)[0] > 0).sum() == 4


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op8_quality_gam(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.93 * got.count()
    model = quality_gam.fit_gam(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    assert {r.score for r in quality_gam.score(clash(frame(spark, ODD)), model).collect()} == {0.5}


def _mixture_brute(model, text):
    """The penalised best of the nested language sets, with proportions by many plain EM rounds."""
    import math

    cell, starts, n = lang_mixture.trigrams([text])
    words = [model.logp[cell[a:b]].sum(axis=0) for a, b in zip(starts, [*starts[1:], len(cell)], strict=True)]
    lik = [[math.exp(max(x - max(w), -60)) for x in w] for w in words]

    def em(langs, share):
        for _ in range(4000):
            new = dict.fromkeys(langs, 0.0)
            for w in lik:
                mix = sum(share[j] * w[j] for j in langs)
                for j in langs:
                    new[j] += share[j] * w[j] / mix / len(lik)
            share = new
        return share, sum(math.log(sum(share[j] * w[j] for j in langs)) for w in lik)

    k = len(model.langs)
    everything, _ = em(range(k), dict.fromkeys(range(k), 1 / k))
    order = sorted(range(k), key=lambda j: -everything[j])
    cost = 4.0 * math.log(len(lik)) / 2
    best = max(range(k), key=lambda j: sum(math.log(w[j]) for w in lik))
    out, value = {best: 1.0}, sum(math.log(w[best]) for w in lik)
    for size in range(2, k + 1):
        some = order[:size]
        share, seen = em(some, {j: max(everything[j], 1e-6) for j in some})
        if seen - (size - 1) * cost > value:
            out, value = share, seen - (size - 1) * cost
    return out


def test_mixtures_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_mixture.fit(docs)
    by = {lang: " ".join(r.text for r in docs.where("lang = '" + lang + "'").limit(4).collect()).split() for lang in model.langs}
    a, b, c = (by[x] for x in model.langs[:3])
    some = [" ".join(a[:60]), " ".join(a[:30] + b[:30]), " ".join(a[:50] + b[:8]), " ".join(a[:20] + b[:20] + c[:20]), " ".join(b[:3]), "zq xv " * 10, " ".join(x[: len(x) // 2 + 1] for x in a[:40] + b[:10])]
    share, n = lang_mixture.mixtures(model, some, *lang_mixture.identify.__defaults__)
    for got, text in zip(share, some, strict=True):
        want = _mixture_brute(model, text)
        assert set(np.flatnonzero(got > 1e-4).tolist()) == {j for j, x in want.items() if x > 1e-4}, text
        assert all(abs(got[j] - x) < 0.02 for j, x in want.items())


def test_pairs_add_what_single_features_miss():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit_gam(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://xnet/es/1", "xnet", "/es/1", None, None),
        ("http://com", "com", "", None, None),
        ("http://a.com#/x", "a.com", "", None, None),
        ("nothing", "", "", None, None),
        (None, "", "", None, None),
        ("x://y://z/w", "y:", "//z/w", None, None),
    ],
)
def test_rules_of_urls(spark, url, host, path, rule, verdict):
    h, p = url_trees.split_url(F.col("url"))
    t = spark.createDataFrame([(url,)], "url string").select(h.alias("host"), p.alias("path"))
    r, v = url_trees.match_rules(F.col("host"), F.col("path"), queries.URL_RULES)
    assert tuple(t.select("host", "path", r, v).first()) == (host, path, rule, verdict)


def test_trees_on_held_out_hosts(spark):
    """Verdicts on labelled pages whose hosts the trees have not seen."""
    rows = url_trees.prepare(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet"), queries.URL_RULES)
    hidden = (F.xxhash64("host") % 7 == 0) & F.col("label").isNotNull()
    seen = rows.withColumns({"label": F.when(~hidden, F.col("label")), "fold": F.when(~hidden, F.col("fold")).otherwise(-1).cast("long")})
    got = url_trees.fit(seen)(seen.join(rows.where(hidden).select("page_id", F.col("label").alias("truth")), "page_id"))
    n, hit = got.count(), got.where((F.col("chance") > 0.5) == (F.col("truth") == 1)).count()
    base = max(got.where("truth = 1").count(), got.where("truth = 0").count())
    print("held out", n, hit, base)
    assert n and hit >= base


def test_rates_leave_out_the_own_fold(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("a", 1, 0.0), ("b", 2, 1.0), ("c", -1, None)], "suffix string, fold long, label double")
    got = {(r.suffix, r.fold): r.rate for r in url_trees._rates(rows, "suffix", "rate", 0.5, 1.0).collect()}
    assert got == {("a", 0): 0.25, ("a", 1): 2.5 / 3, ("a", -1): 2.5 / 4, ("b", 2): 0.5, ("b", -1): 0.75}


def test_trees(spark):
    got = queries.op6_url_trees(spark, SF)
    assert got.where("verdict not in ('allow', 'block') or verdict is null").count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_trees.judge(pages, queries.URL_RULES).collect()] == ["allow"] * 3


def test_chat(spark):
    say = lambda c, *t: [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(t)]
    turns = say(1, "a") + say(2, "a", "b") + say(3, "a", "b", "c") + say(4, "a", "x") + say(5, "a", "b", "c") + say(6, "b") + [(7, 0, None, "a"), (8, 0, "user", None), (None, 0, "user", "q"), (9, None, "user", "z"), (9, None, "user", "z")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_collapse.render(clash(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).drop("text_")).collect()}
    assert set(got) == {3, 4, 6, 7, 8, 9, None}
    assert got[3][:2] == (3, 2) and got[9][0] == 2
    assert got[4][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"


def test_chat_matches_sql(spark):
    from oracle import compare, connect

    assert compare(queries.op10_chat_collapse(spark, SF), connect(SF), chat_collapse.ORACLE_SQL) == ""


def test_empty_tables(spark):
    none = frame(spark, [], n=1)
    assert suffix_dedup.suffix_array_dedup(none).count() == near_dup.near_duplicates(none).count() == compression_rules.compression_rules(none).count() == 0
    assert decontam.decontaminate(none, frame(spark, [(1, "a b")], "item_id long, text string", 1)).count() == 0
    assert token_store.read_tokens(*token_store.write_tokens(none, queries.tokenizer("byte_bpe_50k.json"), 2)).count() == 0
    assert hilbert_pack.pack(none, queries.tokenizer("word_bpe_49k.json"), 1).count() == 0
    assert chat_collapse.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert url_trees.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_gam.score(none, quality_gam.fit(none, labels)).count() == 0
    model = lang_mixture.fit(none.withColumn("lang", F.lit("en")))
    assert model.langs == () and lang_mixture.identify(none, model).count() == 0


def test_long_text_against_brute_force(spark):
    """A text of more than 1 MiB, with passages that repeat within it, across the pieces it is read in, and in another text."""
    rng = random.Random(21)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, edge = say(300), say(250)
    long = say(1 << 19) + passage + say((1 << 19) - 420) + edge + say(90_000) + passage + edge + say(1000)
    docs = [(1, say(50) + edge[:160]), (2, long), (3, passage + say(40))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_array_dedup(frame(spark, docs), keep_text=False).collect()}
    assert got == brute.suffix(docs)
    words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(3000)) for _ in range(140_000))
    rows = [(1, words), (2, words + " end"), (3, "x " + words), (4, words.upper())]
    assert sum(map(len, words)) > 1 << 20
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()} == brute.near(rows)
    items = [(7, " ".join(words.split()[70_000:70_020]))]
    found = decontam.report(decontam.decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string", 1)))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()} == brute.contamination(rows, items)
    judged = {r.doc_id: r for r in compression_rules.compression_rules(frame(spark, rows)).collect()}
    assert all((judged[d].kept, judged[d].n_chunks, judged[d].n_odd_chunks) == brute.compression(t, compression_rules.Limits()) for d, t in rows)


def test_sequences_follow_the_curve(spark, texts):
    rows = hilbert_pack.pack(frame(spark, texts), queries.tokenizer("word_bpe_49k.json"), 1, length=128).collect()
    key = dict(zip((d for d, _ in texts), hilbert_pack.hilbert(hilbert_pack.project(pa.array([t for _, t in texts], pa.string())), hilbert_pack.BITS).tolist(), strict=True))
    order = [(key[r.doc_id], r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_scores_by_hand():
    """Scores are sums of table entries, and a tree of depth one is the best single cut of all."""
    rng = np.random.default_rng(5)
    x = rng.random((300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    m = quality_gam.fit_gam(x, y, rounds=10, pair_rounds=5, n_pairs=2, n_bins=8)
    for row, got in zip(x[:40], m.score(x[:40]), strict=True):
        b = [sum(c <= v for c in cuts) for cuts, v in zip(m.cuts, row, strict=True)]
        f = m.base + sum(t[i] for t, i in zip(m.tables, b, strict=True))
        f += sum(t[b[i] * 8 // (len(m.cuts[i]) + 1), b[j] * 8 // (len(m.cuts[j]) + 1)] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert abs(got - 1 / (1 + np.exp(-f))) < 1e-12
    g, h, lam = rng.normal(size=9), rng.random(9) + 0.1, 2.0
    gain = lambda k: sum(g[s].sum() ** 2 / (h[s].sum() + lam) for s in (slice(0, k), slice(k, 9)))
    k = max(range(1, 9), key=gain)
    want = np.concatenate([np.full(k, g[:k].sum() / (h[:k].sum() + lam)), np.full(9 - k, g[k:].sum() / (h[k:].sum() + lam))])
    assert np.allclose(quality_gam._tree(g, h, 1, lam), want)


def test_labels_are_bounded_by_ids(spark):
    """An id with many rows teaches once for each of its labels; a label counts as often as it occurs."""
    docs = frame(spark, [(1, "a b c")] * 50 + [(1, "other")] + [(2, "d e f g")] + [(None, "x")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, 1), (2, None)], "doc_id long, quality int")
    seen = {}
    quality_gam.fit_gam, kept = lambda x, y: seen.update(n=len(y), ones=int(y.sum())), quality_gam.fit_gam
    try:
        quality_gam.fit(docs, labels)
    finally:
        quality_gam.fit_gam = kept
    assert seen == {"n": 4, "ones": 2}


def test_rows_without_an_id(spark):
    """Rows that repeat, share an id or have none, each with a result of its own text."""
    rows = [(1, "one two three"), (1, "one two three"), (1, "vier fünf sechs"), (None, "one two three"), (None, None), (2, "")]
    docs = clash(frame(spark, rows))
    model = lang_mixture.fit(docs.withColumn("lang", F.when(F.col("text").contains("vier"), "de").otherwise("en")))
    assert sorted(((r.doc_id, r.lang_pred) for r in lang_mixture.identify(docs, model).collect()), key=repr) == sorted([(1, "en"), (1, "en"), (1, "de"), (None, "en"), (None, "und"), (2, "und")], key=repr)
    assert quality_gam.score(docs, quality_gam.fit_gam(np.zeros((0, 19)), np.zeros(0))).count() == compression_rules.compression_rules(docs).count() == len(rows)
    packed = hilbert_pack.pack(docs, queries.tokenizer("word_bpe_49k.json"), 1).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    ids = brute.encode(queries.tokenizer("word_bpe_49k.json"), [t for _, t in rows], 1)
    assert {r.doc_id: r.n for r in packed} == {d: sum(len(x) for (e, _), x in zip(rows, ids, strict=True) if e == d) for d in (1, None, 2)}
    stored = token_store.read_tokens(*token_store.write_tokens(docs, queries.tokenizer("byte_bpe_50k.json"), 2)).collect()
    assert [r.doc_id for r in sorted(stored, key=lambda r: r.start)] == [1, 1, 1, 2, None, None]
    assert sum(r.n_tokens for r in stored) == sum(len(x) for x in brute.encode(queries.tokenizer("byte_bpe_50k.json"), [t for _, t in rows], 2))


def test_stages_on_odd_rows(spark):
    """Every stage on rows that repeat, share an id, have none, have no text, and on none at all, with clashing columns."""
    import corpus_pipeline as p

    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(n))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
    a, b, c = say(120), say(120), say(150)
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (None, b), (None, c), (None, None), (3, ""), (4, "too short"), (5, say(80) + " " + bench), (6, say(150))]
    docs = frame(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    order = lambda rows: sorted(rows, key=repr)
    of = lambda name, d: order((r.doc_id, r.text) for r in dict(p.STAGES)[name](spark, clash(d), SF).collect())
    assert of("quality_rules", docs) == order((d, t) for d, t in rows if brute.compression(t, compression_rules.Limits())[0])
    assert of("near_duplicates", docs) == order([rows[0], rows[2], rows[5], *rows[6:]])
    left = of("repeated_passages", docs)
    assert len(left) == len(rows) and left.count((1, a)) == 2 and (1, b) in left and (None, c) in left and not {(None, b), (2, a + " more")} & set(left)
    assert of("benchmark_free", docs) == order(r for r in rows if r[0] != 5)
    assert {r.doc_id for r in p.packing(spark, clash(docs), SF).collect()} == {1, 2, 3, 4, 5, 6, None}
    for name, stage in p.STAGES:
        none = stage(spark, clash(docs.limit(0)), SF)
        assert none.count() == 0 and (name == "packing" or none.columns == p.COLUMNS)


def test_tables_of_a_job_go(spark):
    """A job deletes its own tables but for the last, and none that another thread has written meanwhile."""
    import os
    import threading

    from tracegrain.sources import scratch

    place = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    other = []

    def elsewhere():
        with scratch.job() as own:
            other.append(scratch.materialise(spark.range(4), "other"))
            assert len(own) == 1

    with scratch.job() as own:
        one = scratch.materialise(spark.range(3), "job")
        thread = threading.Thread(target=elsewhere)
        thread.start()
        thread.join()
        two = scratch.materialise(spark.range(5), "job")
        gone = place(one)
        scratch.discard(spark, own)
        assert len(own) == 1
    assert two.count() == 5 and other[0].count() == 4 and not os.path.exists(gone)
    assert scratch.materialise(spark.range(2), "free").count() == 2


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in compression_rules.compression_rules(docs).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    near = brute.near(rows)
    rows = [r for r in rows if near[r[0]][2]]
    seen, cut = set(), []
    for doc, text in sorted(rows):
        raw, gone = text.encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        cut.append((doc, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination(cut, bench)
    want = {d: len(x) for (d, _), x in zip(cut, brute.encode(queries.tokenizer("word_bpe_49k.json"), [t for _, t in cut], 1), strict=True) if not hit[d][4]}
    got = p.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want


def test_arrow_offsets():
    a = pa.array(["ab", None, "é", ""])
    raw, at = __import__("tracegrain.llm.shared", fromlist=["utf8"]).utf8(a.slice(1))
    assert raw.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
