"""Tokenising whole texts with the tokenizers library, each distinct piece of text once.

A text is cut where a token can never reach across: before a run of white space, and between letters and punctuation. Arrow
numbers the distinct chunks of many texts, and only chunks that this task has not met go through the library; the ids
of the chunks are laid end to end. What a task remembers is bounded in bytes; when it is done, its worker keeps for the next task
only what more than one slice of texts had, within a smaller bound.

The cuts hold for the two designs of vocabulary that ``_design`` knows (byte-level with the space before a word; words
with an end mark); with any other tokenizer whole texts go to the library. So do texts that hold the name of a special
token, which the library takes for that token's id.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracegrain.llm.shared import _SPACE, fold, ranges, utf8

#: Bytes that a task may remember (an entry's text, its ids, and about 150 bytes for its place in a dictionary).
REMEMBER = 96 << 20
#: Bytes that a worker may remember from one task to the next.
KEEP = 24 << 20
#: Texts of about so many bytes are looked at together.
SLICE = 1 << 21

#: White space beyond ASCII as the library's patterns see it.
_WIDE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE = re.compile(rf" [^\t-\r {_WIDE}]+").fullmatch
#: The characters that stand for bytes in byte-level vocabularies: itself for a printable one, else one from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}
#: Letters that stay letters, one for one, when a tokenizer composes and lower-cases them (capital dotted I doesn't).
_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+").fullmatch

_LETTER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT[33:127] = True
_PUNCT[48:58] = False
_PUNCT &= ~_LETTER
_OPENS = _PUNCT.copy()
_OPENS[39] = False  # an apostrophe may go with the letters behind it


def _design(spec: dict) -> str:
    """How this tokenizer (its file's content) cuts texts: "spaced", "ended" or "unknown"."""
    kind = lambda x: (x or {}).get("type")
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer"), spec["model"]
    names = [t["content"] for t in spec.get("added_tokens", [])]
    if kind(model) != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or not all(n.isascii() and n == n.lower() for n in names):
        return "unknown"
    if norm is None and kind(pre) == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not model.get("end_of_word_suffix"):
        return "spaced"
    if kind(norm) == kind(pre) == "Sequence" and [kind(x) for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix"):
        split, *rest = pre["pretokenizers"]
        plain = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if kind(split) == "Split" and split["pattern"] == {"Regex": plain} and split["behavior"] == "Removed" and split["invert"] and [kind(x) for x in rest] == ["ByteLevel"]:
            return "ended"
    return "unknown"


@cache
def _load(path: str):
    """The tokenizer, its model alone, its design, the names of its special tokens, and the ids that are a word's edge."""
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    design, vocab, suffix = _design(spec), tok.get_vocab(with_added_tokens=False), spec["model"].get("end_of_word_suffix")
    # An edge begins a word ("spaced": a space comes first) or ends one ("ended").
    edge = np.zeros(max(vocab.values(), default=0) + 1, bool)
    edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if design == "spaced" else suffix and t.endswith(suffix))]] = True
    # Words of ASCII letters are pre-tokens as they stand: the model needs no patterns for them.
    bare = Tokenizer(tok.model)
    bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    if design != "unknown":
        tok.model._resize_cache(0)  # a chunk comes once
    return tok, bare, design, [t["content"] for t in spec.get("added_tokens", [])], edge


class Chunks:
    """``ids`` tokenises; one object serves one task at a time, which ends with ``rest``."""

    def __init__(self, path: str):
        self.tok, self.bare, self.design, self.names, self.edge = _load(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.held = 0

    def rest(self) -> None:
        """Keep what the most slices had, down to two, within ``KEEP`` bytes; the counts begin afresh."""
        names, n = list(self.known), len(self.known)
        cost = 150 + 4 * self.size[:n].astype(np.int64) + np.fromiter(map(len, names), np.int64, n)
        order = np.argsort(-self.met[:n], kind="stable")
        order = order[(np.cumsum(cost[order]) <= KEEP) & (self.met[order] > 1)]
        ids, sizes = self.flat[ranges(self.first[order], self.size[order])], self.size[order]
        self.forget()
        self._add([names[i] for i in order.tolist()], ids, sizes)

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(ids), len(self.known)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(keys) > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        self.flat[self.used : self.used + n] = ids
        self.first[k : k + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(keys)] = sizes
        self.known.update(zip(keys, range(k, k + len(keys)), strict=True))
        self.used += n
        self.held += 4 * n + sum(map(len, keys)) + 150 * len(keys)

    def _library(self, tok, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array(list(map(len, got)), np.int64)
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _together(self, tok, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Words that go to the library a thousand to a string and are told apart by their edges."""
        flat, _ = self._library(tok, [lead + (" " + lead.strip()).join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
        at = np.flatnonzero(self.edge[flat])
        bounds = np.append(at, len(flat)) if self.design == "spaced" else np.concatenate([[0], at + 1])
        if len(bounds) != len(words) + 1:
            raise ValueError("this vocabulary doesn't mark the edges of words")
        return flat, np.diff(bounds)

    def learn(self, keys: list[str]) -> None:
        """Ask the library for these chunks."""
        spaced = self.design == "spaced"
        plain, line, rest = [], [], []
        for x in keys:
            word = x[1:] if spaced and x[0] == " " else x
            if word.isalpha() and _LATIN(word) and (not spaced or len(word) < len(x)):
                plain.append(x)
            elif spaced and _LINE(x):
                line.append(x)
            else:
                rest.append(x)
        if plain:
            # Capitals are small in the "ended" design; the model reads bytes.
            own = [x[1:] for x in plain] if spaced else [x.lower() for x in plain]
            own = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES) for x in own]
            self._add(plain, *self._together(self.bare, own, "Ġ" * spaced))
        if line:
            self._add(line, *self._together(self.tok, [x[1:] for x in line], " "))
        if rest:
            self._add(rest, *self._library(self.tok, rest))

    def _cut(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The chunks of texts laid end to end, and how many lie before each of the offsets ``at``."""
        space, letter = _SPACE[raw], _LETTER[raw]
        cut = np.zeros(len(raw) + 1, bool)
        inner = cut[1:-1]
        inner |= space[1:] & ~space[:-1]
        # No cut behind white space beyond ASCII.
        wide = np.flatnonzero(inner & (raw[:-1] >= 128)) + 1
        two, one = raw[np.maximum(wide - 2, 0)], raw[wide - 1]
        cut[wide[((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (two == 0x9A) | (two == 0x80) | (two == 0x81)]] = False
        # Letters and punctuation; of the letters beyond ASCII those of U+00C0 to U+00FF, but for two signs.
        inner |= (letter[:-1] & _PUNCT[raw[1:]]) | (_OPENS[raw[:-1]] & letter[1:])
        wide = np.flatnonzero((raw[:-1] >= 128) & _PUNCT[raw[1:]]) + 1
        two, one = raw[np.maximum(wide - 2, 0)], raw[wide - 1]
        cut[wide[(two == 0xC3) & (one != 0x97) & (one != 0xB7)]] = True
        if self.design == "spaced":
            # A single line feed is a pre-token of its own, if what stands before it shows that it is single.
            line = np.flatnonzero((raw[:-1] == 10) & letter[1:]) + 1
            before = raw[np.maximum(line - 2, 0)]
            cut[line[(line >= 2) & (before < 128) & ~_SPACE[before]]] = True
            cut[at] = True
            stops = np.flatnonzero(cut)
            before = np.searchsorted(stops, at)
        else:
            cut[at] = True
            inner |= space[:-1] & ~space[1:]
            cut[:-1] &= ~space
            # Without white space, and without capitals where all is ASCII.
            starts = np.flatnonzero(cut[:-1])
            place = np.cumsum(~space) - 1
            before = np.searchsorted(starts, at)
            raw = raw[~space]
            stops = np.append(place[starts], len(raw))
            high = np.concatenate([[0], np.cumsum(raw >= 128, dtype=np.int64)])[stops]
            raw = np.where(np.repeat(high[1:] == high[:-1], np.diff(stops)), fold(raw), raw)
        n = len(stops) - 1
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))), before

    def _known_ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        raw, at = utf8(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        chunks, before = self._cut(raw, at)
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > REMEMBER:
            self.forget()
        place = list(map(self.known.get, names))
        if None in place:
            new = [x for x, i in zip(names, place, strict=True) if i is None]
            self.learn(new)
            learnt = iter(map(self.known.__getitem__, new))
            place = [next(learnt) if i is None else i for i in place]
        place = np.array(place, np.int64)
        self.met[place] += 1
        index = place[coded.indices.to_numpy()]
        sizes = self.size[index].astype(np.int64)
        of = np.concatenate([[0], np.cumsum(sizes)])[before]
        return self.flat[ranges(self.first[index], sizes)], np.diff(of)

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow array of texts, one text after the other, and the number of each text's ids; null counts as empty."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        if self.design == "unknown":
            return self._library(self.tok, [x or "" for x in texts.to_pylist()])
        named = np.zeros(len(texts), bool)
        for x in self.names:
            named |= pc.match_substring(texts, x, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
        if not named.any():
            return self._known_ids(texts)
        flat, sizes = self._known_ids(pc.if_else(pa.array(named), None, texts))
        more, n = self._library(self.tok, texts.filter(pa.array(named)).to_pylist())
        place = np.cumsum(sizes)[named]
        sizes[named] = n
        return np.insert(flat, np.repeat(place, n), more), sizes


@cache
def chunks(path: str) -> Chunks:
    """One for each worker."""
    return Chunks(path)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id behind each text's ids."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = ids
    return out, sizes + 1


def id_bytes(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The ids of each text as bytes: two for each id if that is enough for all of these, else four."""
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    raw = ids.astype(f"<u{wide}").view(np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * wide
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(raw)]).cast(pa.binary())


def from_bytes(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")
