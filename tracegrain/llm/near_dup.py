"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature has ``HASHES`` components of 16 bits. Two documents whose sets have a similarity of 0.75 differ in about a
quarter of them; the join finds all pairs that differ in at most ``DISTANCE`` (a true pair beyond that has a chance below
one in a million). By the pigeonhole principle such a pair agrees in three components of at least one of 14 chunks of four
or five components, so each document is filed under every choice of three components of each chunk (one or two errors are
allowed in a chunk), 104 keys in all, and no pair within the distance is lost.

Documents with equal sets are one class from the start. A key's documents are not paired with one another: each is paired
with the key's hub first, the document that shares the most keys with others, and the best such pair of each document is
confirmed; a second round does the same with hubs of other components. Only where a key then still has documents of different
components, pairs across components are compared by signature and by an upper bound of what they have in common (each pair under its first
common key only) and confirmed; a key with more than ``BLOCK`` members is dealt out in blocks, each two of which meet in a task of their own. So a group of n near copies costs about n confirmations. Components come from large-star/small-star
rounds on the linked pairs; nothing of that passes the driver but a few counts.

Null or empty texts, and texts without words, have an empty set: they link with nothing and are kept. Texts with fewer
words than a shingle are one shingle; very long texts are signed and compared whole. A row is known by doc_id and text
(``doc`` and ``tie``): rows that repeat are copies of each other, rows that share an id and differ in text are documents of their
own, and so are rows without an id, which come after all others. A component's first row is the one with the smallest doc_id
(ties: the smallest ``tie``); component_id is null where no row of it has an id. An empty table gives an empty
result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import U, fold, materialise, mix, partitions, ranges, shingles, ship_code, slices, utf8, word_hashes, words

WORDS = 5
HASHES, CHUNKS, AGREE = 64, 14, 3
#: With 30 or more equal components, one of 14 chunks has three or more.
DISTANCE = HASHES - CHUNKS * (AGREE - 1) - 2
#: Documents that share keys are told apart further by how many of their shingles fall in each of so many cells: two sets have no more in common than
#: the smaller counts of all cells add up to, so no pair that is similar enough is lost.
CELLS = 448
#: Parts that a hub's partners are dealt into; each gets the hub's text once.
PARTS = 256
_rng = np.random.default_rng(75)
_MUL, _ADD = _rng.integers(0, 2**63, HASHES, dtype=U) * U(2) + U(1), _rng.integers(0, 2**64, HASHES, dtype=U)
_CHOICES = [c for part in np.array_split(np.arange(HASHES), CHUNKS) for c in combinations(part.tolist(), AGREE)]


def shingle_sets(texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts (repeats included), text by text, and n + 1 offsets."""
    raw, at = utf8(texts)
    raw = fold(raw)
    starts, ends, before = words(raw, at)
    h = word_hashes(raw, starts, ends)
    count = np.diff(before)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(off[-1], U)
    for w in range(1, n + 1):
        some = np.flatnonzero(count == w if w < n else count >= n)
        if len(some):
            out[ranges(off[some], size[some])] = mix(shingles(h, w)[ranges(before[some], size[some])] + U(w))
    return out, off


def _least(h, off, full, components):
    """Each component's least value over each set that is not empty."""
    v = np.empty_like(h)
    for k in components if len(full) else ():
        np.multiply(h, _MUL[k], out=v)
        v += _ADD[k]
        yield k, mix(np.minimum.reduceat(v, off[full]))


def _cells(batches):
    for whole in batches:
        for batch in slices(whole):
            h, off = shingle_sets(batch.column("text"))
            counts = np.zeros((batch.num_rows, CELLS), np.uint8)
            for i in range(batch.num_rows):
                counts[i] = np.minimum(np.bincount((np.unique(h[off[i] : off[i + 1]]) % U(CELLS)).astype(np.int64), minlength=CELLS), 255)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in counts], pa.binary())], names=["id", "more"])


def _sign(batches):
    import xxhash

    for whole in batches:
        for batch in slices(whole):
            h, off = shingle_sets(batch.column("text"))
            full = np.flatnonzero(np.diff(off))
            sig = np.zeros((batch.num_rows, HASHES), "<u2")
            for k, least in _least(h, off, full, range(HASHES)):
                sig[full, k] = (least & U(0xFFFF)).astype("<u2")
            n, one, two, sigs = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for i in full.tolist():
                own = np.unique(h[off[i] : off[i + 1]])
                n[i] = len(own)
                print_ = xxhash.xxh3_128_intdigest(own.tobytes())
                one[i], two[i] = (print_ >> 64) - 2**63, (print_ & (2**64 - 1)) - 2**63
                sigs[i] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(n), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())], names=["doc", "tie", "n_shingles", "set_a", "set_b", "sig"])


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _key(sig: np.ndarray, choice: int) -> np.ndarray:
    a, b, c = (sig[:, i].astype(U) for i in _CHOICES[choice])
    return mix((a << U(32) | b << U(16) | c) * U(0x9E3779B97F4A7C15) + U(choice))


def _file(buckets: int):
    """Each class under all its keys, packed by bucket."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            sig = _bytes(batch.column("sig"), 2 * HASHES).view("<u2")
            keys = np.stack([_key(sig, i) for i in range(len(_CHOICES))])
            key, who = keys.reshape(-1), np.tile(ids, len(_CHOICES))
            bucket = (key % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            live = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
            parts = [order[cuts[b] : cuts[b + 1]] for b in live]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([key[p].tobytes() + who[p].tobytes() for p in parts], pa.binary())], names=["bucket", "payload"])

    return run


_MET = "key long, id long, size long"


def _meet(batches):
    """Members of the keys that two classes or more share, and how many each key has."""
    keys, ids = [], []
    for batch in batches:
        for raw in batch.column("payload").to_pylist():
            n = len(raw) // 16
            keys.append(np.frombuffer(raw, U, n))
            ids.append(np.frombuffer(raw, np.int64, n, 8 * n))
    if not keys:
        return
    key, who = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(fresh), len(key)))
    size = np.repeat(size, size)
    shared = size > 1
    yield pa.RecordBatch.from_arrays([pa.array(key[shared].view(np.int64)), pa.array(who[shared]), pa.array(size[shared])], names=["key", "id", "size"])


def best_hubs(members: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """(a, b): for each class the hub of another label that it shares the most keys with, of those not tried.

    A key's hub is its most connected member; counts and maxima only, so no key's members come together."""
    hub = members.groupBy("key").agg(F.max(F.struct("links", F.col("id").alias("hub"), "label")).alias("h")).select("key", "h.hub", F.col("h.label").alias("hub_label"))
    pairs = members.join(hub, "key").where("label <> hub_label").groupBy("id", "hub").agg(F.count("*").alias("n")).select(F.col("id").alias("a"), F.col("hub").alias("b"), "n")
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    return pairs.groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))


def _confirm(percent: int):
    """Rows (b, part, a, text), the hub's own (without a) before its partners."""

    def run(batches):
        held, own = None, None
        for batch in batches:
            hubs, ids = batch.column("b").to_pylist(), batch.column("a").to_pylist()
            linked = np.zeros(batch.num_rows, bool)
            at = 0
            for part in slices(batch):
                h, off = shingle_sets(part.column("text"))
                for i in range(part.num_rows):
                    other = np.unique(h[off[i] : off[i + 1]])
                    if ids[at] is None:
                        held, own = hubs[at], other
                    elif held != hubs[at]:
                        raise ValueError("a hub's text comes before its partners")
                    else:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        linked[at] = 100 * both >= percent * (len(own) + len(other) - both)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked))

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A hub's text isn't joined to each of its partners: it goes once to each part of them."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(PARTS)).alias("part"))
    partners = dealt.join(texts.select(F.col("id").alias("a"), "text"), "a").select("b", "part", "a", "text")
    hubs = dealt.select("b", "part").distinct().join(texts.select(F.col("id").alias("b"), "text"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    both = partners.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return both.mapInArrow(_confirm(percent), "a long, b long")


#: Members of a key that are compared in one task; a larger key's are dealt into blocks, and each two blocks are a group.
BLOCK = 4096


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Adds part, lo and hi: the members of parts lo and hi of a key make a group. ``members`` has its key's number of them as ``count``."""
    parts = F.ceil(F.col("count") / block)
    own = members.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return own.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "count")


def _differs(table) -> np.ndarray:
    """Where a row's group is another one than the row's before it."""
    cols = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
    return np.any([x[1:] != x[:-1] for x in cols], axis=0)


def _across(percent: int):
    """Pairs of a group's members, in different components, whose signatures are near enough."""

    def near(key, ids, n, sig, more, p, q):
        """Of the index pairs those that are near enough and have this as their first common key."""
        same = sig[p] == sig[q]
        keep = np.flatnonzero(same.sum(axis=1) >= HASHES - DISTANCE)
        x, y = more[p[keep]], more[q[keep]]
        most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
        full = ((x == 255) & (y == 255)).any(axis=1)
        keep = keep[full | (100 * most >= percent * (n[p[keep]] + n[q[keep]] - most))]
        p, q, same = p[keep], q[keep], same[keep]
        if not len(p):
            return p, q
        first = np.full(len(p), -1)
        for i, c in enumerate(_CHOICES):
            first = np.where((first < 0) & same[:, c].all(axis=1), i, first)
        own = np.zeros(len(p), bool)
        for i in np.unique(first):
            some = first == i
            own[some] = _key(sig[p[some]], int(i)) == key
        return p[own], q[own]

    def group(key, ids, label, part, n, sig, more, block=256):
        order = np.argsort(label, kind="stable")
        ids, label, part, n, sig, more = (x[order] for x in (ids, label, part, n, sig, more))
        whole = part.min() == part.max()
        for i in range(0, len(ids), block):
            mine = slice(i, i + block)
            for j in range(i, len(ids), 4096):
                rest = slice(j, j + 4096)
                fits = (label[mine, None] != label[None, rest]) & (100 * n[mine, None] >= percent * n[None, rest]) & (100 * n[None, rest] >= percent * n[mine, None])
                if not whole:
                    fits &= part[mine, None] != part[None, rest]
                if j < i + block:
                    fits &= np.arange(i, min(i + block, len(ids)))[:, None] < np.arange(j, min(j + 4096, len(ids)))[None, :]
                x, y = np.nonzero(fits)
                for k in range(0, len(x), 10_000):
                    p, q = near(key, ids, n, sig, more, x[k : k + 10_000] + i, y[k : k + 10_000] + j)
                    if len(p):
                        yield np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])

    def run(batches):
        held = None

        def emit(table):
            key, ids, label, part, n = (table.column(c).to_numpy() for c in ("key", "id", "label", "part", "n"))
            sig, more = _bytes(table.column("sig"), 2 * HASHES).view("<u2"), _bytes(table.column("more"), CELLS)
            edges = np.append(np.flatnonzero(np.concatenate([[True], _differs(table)])), len(key))
            out = [p for a, b in zip(edges[:-1], edges[1:], strict=True) for p in group(key[a : a + 1].view(U)[0], ids[a:b], label[a:b], part[a:b], n[a:b], sig[a:b], more[a:b])]
            if out:
                both = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            last = np.flatnonzero(_differs(table))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from emit(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    return run


#: Links and labels are few beside the documents: a table of them is written by a task for so many partitions; of classes and keys by one for two.
FEW, SOME = 8, 2
#: Parts that a component's members are dealt into when they look for its first row.
SALT = 32


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches; large-star/small-star rounds."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", FEW)
    while True:
        many = e.groupBy("a").count().where("count > 1").limit(1).count()
        if not many and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialise(small, "stars", FEW)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


#: Rounds of hub pairs before pairs across components are compared one by one.
ROUNDS = 2


def _merged(label: DataFrame | None, links: DataFrame, tag: str) -> DataFrame:
    """Components (id, component) after adding links (a, b) to those known."""
    if label is None:
        return materialise(components(links), tag, FEW)
    at = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    bridges = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
    bridges = materialise(bridges, f"{tag}-bridges", FEW)
    more = components(bridges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    ids = label.unionByName(bridges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti").select("id", F.col("id").alias("component")))
    up = more.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return materialise(ids.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")), tag, FEW)


def _key_of_rows(docs: DataFrame, *more) -> DataFrame:
    """Rows with what they are known by: doc (the largest number without a doc_id) and a hash of the text."""
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("tie"), *more)


_LAST = 2**63 - 1


def labelled(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc, tie, n_shingles, first: struct<doc, tie>) of each row; ``first`` is its component's first row."""
    if percent < 75:
        raise ValueError("the signature distance is set for a similarity of 0.75 or more")
    spark = docs.sparkSession
    ship_code(spark)
    src = _key_of_rows(docs, "text")
    signed = materialise(src.mapInArrow(_sign, "doc long, tie long, n_shingles long, set_a long, set_b long, sig binary"), "signatures")
    # A class of equal sets is known by half of its sets' 128-bit fingerprint.
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("doc", "tie")).alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("id", F.col("set_a")), "classes", SOME)
    n = partitions(spark, classes.count() * len(_CHOICES) * 16)
    filed = classes.select("id", "sig").mapInArrow(_file(8 * n), "bucket int, payload binary").repartition(n, "bucket")
    met = materialise(filed.mapInArrow(_meet, _MET), "met", SOME, n)
    links = met.groupBy("id").agg(F.sum("size").alias("links"))
    members = materialise(met.select("key", "id").join(links, "id"), "members", SOME)
    near = classes.join(links, "id", "left_semi").select("id", "first.doc", "first.tie")
    # One text of each class that shares a key.
    texts = materialise(src.join(near, ["doc", "tie"]).select("id", "text").dropDuplicates(["id"]), "near-texts", SOME)
    label, tried = None, None
    for step in range(ROUNDS):
        own = members.withColumn("label", F.col("id")) if label is None else members.join(label, "id", "left").withColumn("label", F.coalesce("component", "id"))
        pairs = materialise(best_hubs(own, tried), "hub-pairs", FEW)
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = _merged(label, confirm(pairs, texts, percent), f"components-{step}")
    named = members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("count")).where("least < most").select("key", "count")
    open_ = materialise(named.join(split, "key"), "open", SOME)
    more = texts.join(open_.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_cells, "id long, more binary")
    rest = in_blocks(open_, BLOCK).join(classes.select("id", "n", "sig").join(more, "id"), "id")
    dealt = rest.select("key", "lo", "hi", "id", "label", "part", "n", "sig", "more").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    pairs = dealt.mapInArrow(_across(percent), "a long, b long").join(tried, ["a", "b"], "left_anti")
    label = _merged(label, confirm(pairs, texts, percent), "components")
    firsts = label.join(classes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("top"))
    # A component may hold a third of all classes: each of its parts finds its first row by itself.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = label.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(firsts, ["component", "salt"]).select("id", "top")
    of_class = classes.join(salted, "id", "left").select("set_a", "set_b", F.coalesce("top", "first").alias("first"))
    out = signed.select("doc", "tie", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    return out.select("doc", "tie", "n_shingles", F.coalesce("first", F.struct("doc", "tie")).alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; kept where the row's doc_id is its component's."""
    own = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    rows = labelled(docs, percent).select(own("doc").alias("doc_id"), "n_shingles", own("first.doc").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component, one of those that repeat; rows
    with an empty set all stay."""
    found = labelled(docs, percent)
    stay = found.where((F.col("n_shingles") == 0) | (F.struct("doc", "tie") == F.col("first"))).select("doc", "tie", (F.col("n_shingles") > 0).alias("full")).distinct()
    rows = _key_of_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(stay, ["doc", "tie"])
    # Rows with an empty set are told apart by a number.
    rows = rows.withColumn("apart", F.when(F.col("full"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return rows.dropDuplicates(["doc", "tie", "apart"]).select("row.*")
