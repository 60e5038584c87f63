"""Byte-level BPE of whole partitions of texts.

Texts are split into words with array operations over all code points of a batch, following the
pattern of the public byte-level vocabularies:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Words that a worker hasn't met are merged together, by a pair occurrence index: each mergeable pair
of neighbours is listed under its rank with all its positions in the partition; the active ranks are
applied in ascending order, and each merge updates the lists of the pairs it touches. A merged token is
never part of a pair of lower rank, so this gives what merging each word by itself gives.

Null and empty texts have no tokens. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Code points worked on at once; a longer text is a chunk of its own.
CHUNK = 1_500_000
#: Words a worker keeps; beyond that it forgets all and starts again.
MOST_WORDS = 500_000
LETTER, NUMBER, SPACE, OTHER, GAP = range(5)
NONE = np.int64(1 << 40)
_BASE = 0x9E3779B97F4A7C15 | 1
#: White space as the pattern's \s has it.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            kinds[c] = LETTER
        elif g == "N":
            kinds[c] = NUMBER
    kinds[_SPACES] = SPACE
    return kinds


@cache
def _mix() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words start; a code point of kind GAP is a word of its own."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, dtype=bool)
    run = np.ones(n, dtype=bool)
    run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == GAP)
    start = run.copy()
    solid = (kind != SPACE) & (kind != GAP)
    # A blank before letters, numbers or other signs belongs to them; the white space before it doesn't.
    before = run[1:] & solid[1:] & (kind[:-1] == SPACE)
    start[1:] &= ~(before & (cp[:-1] == 32))
    start[:-1] |= before
    # Contractions: an apostrophe that starts a word, with the letters after it.
    at = np.flatnonzero(start & (cp == 39))
    if len(at):
        padded = np.concatenate([cp, np.zeros(2, dtype=cp.dtype)])
        same = np.concatenate([kind, np.full(2, GAP, dtype=kind.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = np.isin(a, [115, 116, 109, 100])  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        one &= same[at + 1] == LETTER
        two &= (same[at + 1] == LETTER) & (same[at + 2] == LETTER)
        for which, size in ((one, 2), (two, 3)):
            i = at[which]
            start[i + 1] = False
            after = i + size
            start[after[after < n]] = True
    return start


@dataclass
class Words:
    """Words of consecutive texts: those of text i are first[i] to first[i+1]; code is into the Encoder's tables."""

    first: np.ndarray
    code: np.ndarray
    start: np.ndarray  # code points from the start of the chunk, without gaps counted
    length: np.ndarray


class Encoder:
    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([(vocab[a] << 17) | vocab[b] for a, b in merges], dtype=np.int64)
        by = np.argsort(pairs, kind="stable")
        self._pairs, self._rank = pairs[by], by.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        signs = _byte_signs()
        self._bytes = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int64)
        self._forget()

    def _forget(self) -> None:
        self._index: dict[int, int] = {}
        self._store = np.zeros(1 << 16, dtype=np.uint32)  # code points of known words, one after the other
        self._stored = 0
        self._where = np.zeros(1 << 12, dtype=np.int64)
        self._size = np.zeros(1 << 12, dtype=np.int64)
        self._known = 0
        self._encoded = 0
        self.token_at = np.zeros(1, dtype=np.int64)
        self.tokens = np.zeros(0, dtype=np.int32)

    def token_count(self, code: np.ndarray) -> np.ndarray:
        return (self.token_at[1:] - self.token_at[:-1])[code]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = (left << 17) | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, one after the other, and how many each has."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        token = self._bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        owner = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        edge = np.flatnonzero(owner[1:] != owner[:-1])
        after[edge], before[edge + 1] = n, -1
        after[-1:] = n
        rank = np.full(n + 1, NONE)
        i = np.flatnonzero(after < n)
        rank[i] = self._rank_of(token[i], token[after[i]])
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            r = rank[at]
            by = np.argsort(r, kind="stable")
            at, r = at[by], r[by]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for one, these in zip(r[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if one in places:
                    places[one].append(these)
                else:
                    places[one] = [these]
                    heapq.heappush(active, one)

        enlist(i)
        alive = np.ones(n, dtype=bool)
        while active:
            now = heapq.heappop(active)
            at = places.pop(now)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[rank[at] == now]
            if len(at) > 1:
                # Of a row of equal tokens, each pair overlaps the next: every second one is merged.
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(chained, 0, k))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            token[at] = self._merged[now]
            alive[gone] = False
            rank[gone] = NONE
            following = after[gone]
            after[at] = following
            has = following < n
            before[following[has]] = at[has]
            left = before[at]
            left = left[left >= 0]
            touched = np.unique(np.concatenate([at, left])) if len(at) + len(left) > 1 else at
            nxt = after[touched]
            live = nxt < n
            rank[touched[~live]] = NONE
            t = touched[live]
            rank[t] = self._rank_of(token[t], token[nxt[live]])
            enlist(t)
        return token[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(words))

    def _enter(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Codes of new words: their code points are stored, their tokens come later."""
        codes = np.arange(self._known, self._known + len(start))
        total = int(length.sum())
        while self._known + len(start) > len(self._where):
            self._where, self._size = np.resize(self._where, 2 * len(self._where)), np.resize(self._size, 2 * len(self._size))
        while self._stored + total > len(self._store):
            self._store = np.resize(self._store, 2 * len(self._store))
        self._where[codes], self._size[codes] = self._stored + np.cumsum(length) - length, length
        self._store[self._stored : self._stored + total] = cp[_ranges(start, length)]
        self._stored += total
        self._known += len(start)
        return codes

    def _encode_new(self) -> None:
        """Tokens of the words entered since the last time."""
        if self._encoded == self._known:
            return
        text = self._store[: self._stored]
        words = [text[a : a + s].tobytes().decode("utf-32-le").encode() for a, s in zip(self._where[self._encoded : self._known].tolist(), self._size[self._encoded : self._known].tolist(), strict=True)]
        tokens, counts = self.merge(words)
        self.token_at = np.concatenate([self.token_at, self.token_at[-1] + np.cumsum(counts)])
        self.tokens = np.concatenate([self.tokens, tokens])
        self._encoded = self._known

    def _codes(self, cp: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        up, down = _power_tables(len(cp) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, dtype=np.uint64)
            np.cumsum(_mix()[cp] * up[:-1], out=total[1:])
            hashes = (total[start + length] - total[start]) * down[start]
        which, distinct = pd.factorize(hashes)
        get = self._index.get
        codes = np.fromiter((get(h, -1) for h in distinct.tolist()), dtype=np.int64, count=len(distinct))
        new = codes < 0
        if new.any():
            first = np.empty(len(distinct), dtype=np.int64)
            first[which[::-1]] = np.arange(len(start))[::-1]
            codes[new] = self._enter(cp, start[first[new]], length[first[new]])
            self._index.update(zip(distinct[new].tolist(), codes[new].tolist(), strict=True))
        code = codes[which]
        # Hashes only propose: every word is held against the stored one.
        wrong = self._size[code] != length
        same = np.minimum(self._size[code], length)
        differs = self._store[_ranges(self._where[code], same)] != cp[_ranges(start, same)]
        if differs.any():
            wrong[np.repeat(np.arange(len(start)), same)[differs]] = True
        exact: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong).tolist():
            text = cp[start[i] : start[i] + length[i]].tobytes()
            if text not in exact:
                exact[text] = int(self._enter(cp, start[i : i + 1], length[i : i + 1])[0])
            code[i] = exact[text]
        return code

    def words(self, texts: pa.Array) -> list[Words]:
        """Words of the texts, null ones taken as empty; all their tokens are known afterwards."""
        if self._known > MOST_WORDS:
            self._forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        out, lo = [], 0
        while lo < len(sizes):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK, side="right")))
            out.append(self._chunk(texts.slice(lo, hi - lo).to_pylist(), sizes[lo:hi]))
            lo = hi
        self._encode_new()
        return out

    def _chunk(self, texts: list[str], sizes: np.ndarray) -> Words:
        cp = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
        kind = _classes()[cp]
        ends = np.cumsum(sizes + 1)
        kind[ends[:-1] - 1] = GAP
        at = np.flatnonzero(word_starts(cp, kind))
        length = np.diff(at, append=len(cp))
        at_text = np.concatenate([[0], ends[:-1]])
        real = kind[at] != GAP if len(at) else np.zeros(0, dtype=bool)
        start, length = at[real], length[real]
        first = np.searchsorted(start, np.append(at_text, len(cp) + 1))
        return Words(first, self._codes(cp, start, length), start, length)

    def ids(self, w: Words) -> pa.ListArray:
        """Token ids of each text."""
        n = self.token_count(w.code)
        flat = self.tokens[_ranges(self.token_at[w.code], n)]
        offsets = np.concatenate([[0], np.cumsum(n)])[w.first]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    def counts(self, w: Words) -> np.ndarray:
        """Number of tokens of each text."""
        total = np.concatenate([[0], np.cumsum(self.token_count(w.code))])
        return np.diff(total[w.first])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., start[1], ... : length[i] numbers from each start[i]."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """The encoder of this worker."""
    return Encoder(path)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[tuple[Encoder, pa.RecordBatch, Words]]:
    """Each batch cut into parts whose words are known."""
    e = encoder(path)
    for batch in batches:
        lo = 0
        for w in e.words(batch.column(batch.schema.get_field_index(text))):
            n = len(w.first) - 1
            yield e, batch.slice(lo, n), w
            lo += n
