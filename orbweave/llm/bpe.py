"""BPE encoding and decoding by speculation and verification.

A text is cut at white space into chunks, chunks into pre-tokens. For pre-tokens not met before, greedy longest match
proposes tokens; a vectorised check tests every adjacent pair of proposed tokens; only words with a failing pair go
through the exact merge loop. The check rests on this fact: a token sequence is what the merges make exactly if every
token is what the merges make of its own characters and no merge across any border would have come first.

Nulls count as empty texts, and an empty text has no tokens. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Entries of a worker's cache of chunks; it is emptied when full, which changes speed only.
CACHE_ENTRIES = 1_600_000

# Fixed values of the vocabulary format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: Letters up to here lower-case and compose alike in every Unicode library.
_SIMPLE = re.compile(r"[\x00-\x1b\x20-\x7e\xa1-\xff]*")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_LAST = 1 << 40
#: Letters of a word that is proposed by itself: the steps of the others are shared.
LONG_WORD = 48
#: Fills up short rows; no merge has it.
_PAD = (1 << 20) - 1
#: A word of letters and one mark after it, most frequent among chunks that are not words.
_MARKED = re.compile(r"[a-z]+[!-&(-/:-@\[-`{-~]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


def slices(flat: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
    """Runs of ids, one after the other, as little-endian 32-bit integers."""
    data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
    return (data[i:j] for i, j in zip([0, *ends], ends))


def lower_simple(text: str) -> str:
    """Lower case, for a text of Latin-1 characters alone, where that is the same for the text and for its parts."""
    if text.isascii():
        return text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Lookup:
    """A hash table from integers to integers that numpy reads: few of its slots are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        self.default, self.shift = default, np.uint64(64 - max(10, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 0
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] < 0
            took, first = np.unique(at[left[free]], return_index=True)
            winners = left[free][first]
            self.keys[took], self.values[took] = keys[winners], values[winners]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are at least 0; the default where there is none."""
        at = self._home(keys)
        own = self.keys[at]
        out = np.where(own == keys, self.values[at], self.default)
        for step in range(1, self.probes):  # on, where another key stands in the way
            open_ = np.flatnonzero((own != keys) & (own >= 0)) if step == 1 else open_[(own != flat[open_]) & (own >= 0)]
            if not len(open_):
                break
            if step == 1:
                flat, at, shape, out = keys.reshape(-1), at.reshape(-1), out.shape, out.reshape(-1)
            own = self.keys[at[open_] + step]
            hit = open_[own == flat[open_]]
            out[hit] = self.values[at[hit] + step]
        return out if out.shape == keys.shape else out.reshape(keys.shape)


class WordBpe:
    """Encoder and decoder for a vocabulary file of byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        n = len(self.strings)
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.full(n, -1, np.int64)  # rank of the merge that makes the token; -1: a character
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        ids = np.array([[self.vocab[a], self.vocab[b], self.vocab[a + b]] for a, b in pairs])
        ranks = np.arange(len(ids))
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(ids.tolist())}
        self.results = ids[:, 2]
        self.result = self.results.tolist()
        self.left[ids[:, 2]], self.right[ids[:, 2]], self.made[ids[:, 2]] = ids[:, 0], ids[:, 1], ranks
        self.ranks = Lookup((ids[:, 0] << 20) | ids[:, 1], ranks, _LAST)
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.find = regex.compile(PRE_TOKEN).findall
        self.sound = np.full(n, -1, np.int8)  # whether the merges make a token; -1: not looked at yet
        self.prefix = dict.fromkeys((w[:i] for w in self.vocab for i in range(1, len(w))), -1) | self.vocab  # -1: only begins tokens
        self._trie()
        self.letter, self.last_letter = (np.array([self.vocab.get(chr(c) + tail, 0) for c in range(512)]) for tail in ("", WORD_END))
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.path, self._library = path, None
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.exact_merges, self.entries = 0, CACHE_ENTRIES

    # -- words -----------------------------------------------------------------------------------------------------

    def _trie(self) -> None:
        """Nodes of the tokens' trie: children by node and character, and the token that ends in a node, or with the word."""
        nodes = {"": 0}
        for w in self.vocab:
            w = w.removesuffix(WORD_END)
            for i in range(1, len(w) + 1):
                nodes.setdefault(w[:i], len(nodes))
        names = list(nodes)[1:]
        self.children = Lookup(np.array([nodes[w[:-1]] << 9 | min(ord(w[-1]), 511) for w in names]), np.arange(1, len(nodes)), -1)
        self.token_at, self.whole_at = (np.array([self.vocab.get(w + tail, -1) for w in nodes]) for tail in ("", WORD_END))
        self.token_at[0] = self.whole_at[0] = -1

    def _merge(self, ids: list[int]) -> list[int]:
        """The merges themselves: the lowest rank first, the leftmost of equals."""
        ids, get = list(ids), self.rank.get
        ranks = [get(a << 20 | b, _LAST) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < _LAST:
            i = ranks.index(best)
            ids[i : i + 2] = [self.result[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _LAST)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _LAST)
        return ids

    def _is_sound(self, token: int) -> bool:
        """Whether the merges make this token of its own characters."""
        parts, stack = [], [token]
        while stack:
            t = stack.pop()
            if self.made[t] < 0:
                parts.append(t)
            else:
                stack += [int(self.right[t]), int(self.left[t])]
        return self._merge(parts) == [token]

    def _propose(self, word: str) -> list[int]:
        """Greedy longest match; the last character carries the word's end."""
        out, i, n, whole, get = [], 0, len(word), self.vocab.get, self.prefix.get
        while i < n:
            t = whole(word[i:] + WORD_END)
            if t is not None:
                out.append(t)
                break
            best, end, j = None, i, i + 1
            while j < n and (t := get(word[i:j])) is not None:
                if t >= 0:
                    best, end = t, j
                j += 1
            out.append(best)
            i = end
        return out

    def _propose_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of many words at once: all tokens, and how many each word has.

        All words walk down the trie together, a character a step; who can't go on takes the longest token passed and
        begins again behind it. Tokens stand at their first character until all are found.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        flow = np.append(np.frombuffer("".join(words).encode("utf-16-le"), "<u2").astype(np.int64), 0)
        found = np.full(len(flow) - 1, -1, np.int64)
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            own = self._propose(words[i])
            found[ends[i] - lengths[i] : ends[i] - lengths[i] + len(own)] = own
        end = ends[lengths <= LONG_WORD]
        start = end - lengths[lengths <= LONG_WORD]
        at, node, best, after = start.copy(), np.zeros(len(start), np.int64), np.full(len(start), -1), start.copy()
        while len(start):
            child = self.children.get(node << 9 | flow[at])
            child[at >= end] = -1
            go = child >= 0
            node = np.where(go, child, node)
            at = at + go
            last = at == end
            token = np.where(last, self.whole_at[node], self.token_at[node])
            take = go & (token >= 0)
            best, after = np.where(take, token, best), np.where(take, at, after)
            stop = ~go | last
            found[start[stop]] = best[stop]
            start = np.where(stop, after, start)
            at, node, best = np.where(stop, start, at), np.where(stop, 0, node), np.where(stop, -1, best)
            more = start < end
            if not more.all():
                start, end, at, node, best, after = (x[more] for x in (start, end, at, node, best, after))
        has = found >= 0
        return found[has], np.add.reduceat(has, ends - lengths, dtype=np.int64)

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of merges by pair; _LAST where there is none."""
        return self.ranks.get(keys)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """The merges themselves, for words in the byte alphabet: in every step each word makes its first merge.

        Words of about one length go together, short ones padded at the end: each step shortens the block by one.
        """
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flow = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")
        ends = np.cumsum(lengths)
        ids_flow = self.letter[flow]
        ids_flow[ends - 1] = self.last_letter[flow[ends - 1]]
        groups = np.where(lengths <= 16, (lengths + 3) // 4, 1 + np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64) * 16)
        for group in np.unique(groups):
            who = np.flatnonzero(groups == group)
            width = int(lengths[who].max())
            columns = np.arange(width)[None, :]
            at = (ends[who] - lengths[who])[:, None] + columns
            ids = np.where(columns < lengths[who][:, None], ids_flow[np.minimum(at, len(ids_flow) - 1)], _PAD)
            while len(who):
                ranks = self.ranks_of(ids[:, :-1] << 20 | ids[:, 1:])
                first = ranks.argmin(1) if ids.shape[1] > 1 else np.zeros(len(ids), np.int64)
                best = ranks[np.arange(len(ids)), first] if ids.shape[1] > 1 else np.full(len(ids), _LAST)
                live = best < _LAST
                if not live.all():
                    done = ids[~live]
                    kept = done != _PAD
                    for i, code in zip(who[~live].tolist(), slices(done[kept], kept.sum(1))):
                        out[i] = code
                    who, ids, first, best = who[live], ids[live], first[live], best[live]
                if len(who):
                    ids[np.arange(len(ids)), first] = self.results[best]
                    columns = np.arange(ids.shape[1] - 1)[None, :]
                    ids = np.take_along_axis(ids, columns + (columns > first[:, None]), 1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of adjacent tokens: no merge across the border would have come before those that made them.

        Both are unmade step by step, the part made last first; a part at the border may merge across it while it
        exists: until the merge that swallowed it. Of equal merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), _LAST), np.full(len(a), _LAST - 1)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 20) | y
            rank = self.ranks_of(key)
            bad = (rank < until_a[live]) | (rank <= until_b[live])
            good[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            made_x, made_y = self.made[x], self.made[y]
            go_x = made_x > made_y
            go_y = ~go_x & (made_y >= 0)
            i, j = live[go_x], live[go_y]
            until_a[i], a[i] = made_x[go_x], self.right[x[go_x]]
            until_b[j], b[j] = made_y[go_y], self.left[y[go_y]]
            live = live[go_x | go_y]
        return good

    def learn(self, words: list[str]) -> None:
        """Tokens of words in the byte alphabet, into ``self.words``."""
        flat, lengths = self._propose_many(words)
        starts = np.cumsum(lengths) - lengths
        tokens = np.unique(flat)
        for t in tokens[self.sound[tokens] < 0].tolist():
            self.sound[t] = self._is_sound(t)
        # each pair stands at its second token; a word's first token has none
        fine = self.sound[flat] > 0
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        pairs, which = np.unique(flat[inner - 1] << 20 | flat[inner], return_inverse=True)
        fine[inner] &= self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]
        good = np.logical_and.reduceat(fine, starts)
        self.words.update(zip(words, slices(flat, lengths)))
        failing = [words[i] for i in np.flatnonzero(~good).tolist()]
        self.exact_merges += len(failing)
        if failing:
            self.words.update(zip(failing, self.merge_many(failing)))

    # -- texts -----------------------------------------------------------------------------------------------------

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a text, in the byte alphabet."""
        if chunk.isascii() or _SIMPLE.fullmatch(chunk) and unicodedata.is_normalized("NFC", chunk):
            found = self.find(chunk.lower())
            if chunk.isascii() and chunk.isprintable():
                return found
            return [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.table) for x in found]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return [x for x, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))]

    def _learn_chunks(self, chunks: set[str]) -> bool:
        """Tokens of chunks, into ``self.chunks``; whether it had to be emptied first."""
        emptied = len(self.chunks) > 0 and len(self.chunks) + len(chunks) > self.entries
        if emptied:
            self.chunks.clear()
            self.words.clear()
        marked = _MARKED.fullmatch
        pieces = {c: (c.lower(),) if c.isalpha() and c.isascii() else (c[:-1], c[-1]) if marked(c) else self._pieces(c) for c in chunks}
        new = set(chain.from_iterable(pieces.values())).difference(self.words)
        if new:
            self.learn(list(new))
        words = self.words
        for c, p in pieces.items():
            self.chunks[c] = words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p])
        return emptied

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers; strings of special tokens count as ordinary text."""
        split = [[t] if _ODD_SPACE.search(t) else lower_simple(t).split() for t in texts]
        new = set(chain.from_iterable(split)).difference(self.chunks)
        collects = gc.isenabled()
        gc.disable()  # learning makes very many lists and no cycle
        try:
            if new and self._learn_chunks(new):  # the cache was emptied on the way
                self._learn_chunks(set(chain.from_iterable(split)).difference(self.chunks))
        finally:
            if collects:
                gc.enable()
        get = self.chunks.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as the public library gives them without added tokens: strings of special tokens are those."""
        texts = [t or "" for t in texts]
        if self.cut is None or not any("<|" in t for t in texts):
            return self.encode_plain(texts)
        parts = [self.cut.split(t) for t in texts]
        done = iter(self.encode_plain([x for p in parts for x in p[::2]]))
        return [b"".join(next(done) if i % 2 == 0 else np.array([self.special[x]], "<u4").tobytes() for i, x in enumerate(p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, space between: these vocabulary files name no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_coders: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file; workers are reused, so its cache serves many tasks."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def forget() -> None:
    """Let go of the worker's encoders, for tasks that need the memory and no encoder."""
    _coders.clear()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True) -> DataFrame:
    """Token ids (array<int>) and decoded text of each row, or with ``ids=False`` only their digests.

    One pass without a shuffle; a task holds one Arrow batch and a bounded cache of chunks. Null texts have no tokens.
    """
    short_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long, " + ("token_ids array<int>, decoded string" if ids else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary)
        for batch in batches:
            codes = bpe.encode(batch.column(1).to_pylist())
            counts = pa.array([len(c) // 4 for c in codes], pa.int64())
            if ids:
                more = [pa.array([np.frombuffer(c, "<i4") for c in codes], pa.list_(pa.int32())), pa.array([bpe.decode(c) for c in codes])]
            else:
                more = [pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()), pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in codes], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *more], names=[id_col, "n_tokens", *(["token_ids", "decoded"] if ids else ["ids_sha256", "decoded_sha256"])])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
