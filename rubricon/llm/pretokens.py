"""Pre-tokens of byte-level BPE by array operations, and a worker's cache of encoded ones.

The split is that of the public byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

with strings of special tokens taken out first, as the tokenizers library does. Which
characters are letters, numbers or white space is asked of the library itself, once for each
character met. The library encodes every distinct pre-token; only repeats come from the cache.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from rubricon.llm.flat import ROUND_BYTES, gather_spans, row_rounds, span_hash

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 255


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=4)
def special_strings(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as file:
        return [t["content"].encode() for t in json.load(file)["added_tokens"]]


class Splitter:
    """Pre-token boundaries of flat UTF-8 texts."""

    def __init__(self, path: str):
        self.split_one = load_tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.specials = special_strings(path)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[:128] = [self._ask(c) for c in range(128)]

    def _ask(self, code: int) -> int:
        for kind, mate in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.split_one(mate + chr(code))) == 1:
                return kind
        return SPACE

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kind[codes]
        for code in np.unique(codes[kinds == UNKNOWN]):
            self.kind[code] = self._ask(int(code))
        return self.kind[codes] if (kinds == UNKNOWN).any() else kinds

    def _chars(self, data: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """(byte position of each character, None where all are ASCII; kind of each)."""
        if data.max(initial=0) < 128:
            return None, self.kind[data]
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kinds = self.kind[lead & np.uint8(127)]
        wide = np.flatnonzero(lead >= 128)
        b = np.concatenate([data, np.zeros(3, np.uint8)])
        p, first = at[wide], lead[wide].astype(np.int64)
        b1, b2, b3 = (b[p + k].astype(np.int64) & 63 for k in (1, 2, 3))
        codes = np.where(
            first < 0xE0,
            (first & 31) << 6 | b1,
            np.where(first < 0xF0, (first & 15) << 12 | b1 << 6 | b2, (first & 7) << 18 | b1 << 12 | b2 << 6 | b3),
        )
        kinds[wide] = self._kinds(codes)
        return at, kinds

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte starts of the pre-tokens and the end, first pre-token of each row and the end)."""
        if not len(data):
            return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        at, kind = self._chars(data)
        char_at = (lambda p: p) if at is None else (lambda p: np.searchsorted(at, p))
        lead, n = data if at is None else data[at], len(kind)
        first = np.zeros(n + 1, bool)
        edges = char_at(offsets)
        first[edges] = True
        whole = self._special_spans(data, offsets)
        for lo, hi in whole:
            first[char_at(lo)] = first[char_at(hi)] = True
        first[n] = True
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # The last of several white characters before a word starts a pre-token; a space joins the word.
        joins = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        start[joins] = True
        start[joins[lead[joins] == 0x20] + 1] = False
        quotes = np.flatnonzero((lead == 0x27) & start[:n])
        if len(quotes):
            self._contractions(lead, first, start, quotes, n)
        for lo, hi in whole:
            start[char_at(lo) + 1 : char_at(hi)] = False
        begins = np.flatnonzero(start)
        row_bounds = np.searchsorted(begins, edges)
        begins[-1] = n
        return (begins if at is None else np.append(at, len(data))[begins]), row_bounds

    @staticmethod
    def _contractions(lead, first, start, quotes, n):
        ahead = np.concatenate([lead, np.zeros(3, np.uint8)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        inside = ~first[np.minimum(quotes + 1, n)]
        short = quotes[inside & np.isin(one, list(b"stmd"))]
        pair = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        long = quotes[inside & pair & ~first[np.minimum(quotes + 2, n)]]
        for which, size in ((short, 2), (long, 3)):
            start[which + 1] = False
            start[which + size] = True

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        found, raw = [], data.tobytes()
        for text in self.specials:
            lo = raw.find(text)
            while lo >= 0:
                hi = lo + len(text)
                if np.searchsorted(offsets, lo, "right") == np.searchsorted(offsets, hi, "left"):
                    found.append((lo, hi))
                lo = raw.find(text, hi)
        return found


def long_text_cuts(data: np.ndarray, lo: int, hi: int, limit: int) -> list[int]:
    """Places where a long text can be cut without changing its pre-tokens: before a single
    space between two ASCII lower-case letters, about every `limit` bytes."""
    cuts, at = [lo], lo
    while hi - at > 2 * limit:
        look = data[at + limit : hi]
        letter = (look - np.uint8(97)) < 26
        for width in (4096, len(look)):
            piece = slice(0, width)
            w = (look[1:-1] == 0x20)[piece] & letter[:-2][piece] & letter[2:][piece]
            if w.any():
                break
        if not w.any():
            break
        at = at + limit + 1 + int(np.argmax(w))
        cuts.append(at)
    return [*cuts, hi]


class WordEncoder:
    """Ids of pre-tokens: a direct-mapped cache of fixed size before the library.

    `store_words` bounds what a worker keeps; when it is full the cache starts anew.
    """

    def __init__(self, path: str, slots_log2: int = 21, store_words: int = 1_400_000):
        self.tokenizer, self.splitter = load_tokenizer(path), Splitter(path)
        self.shift, self.store_words = np.uint64(64 - slots_log2), store_words
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.words = np.full(1 << slots_log2, -1, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.words.fill(-1)
        self.count = self.used = 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)

    def encode_misses(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids in each) of distinct pre-tokens, by the library."""
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [e.ids for e in encoded]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        while self.count + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        fresh = np.arange(self.count, self.count + len(lengths))
        self.starts[fresh] = self.used + np.cumsum(lengths) - lengths
        self.lengths[fresh] = lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.count, self.used = self.count + len(lengths), self.used + len(flat)
        return fresh

    def words_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(store index of each pre-token, first pre-token of each row and the end)."""
        bounds, row_bounds = self.splitter.split(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        return self.words_at(data, starts, ends, span_hash(data, starts, ends)), row_bounds

    def words_at(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Store index of the pre-tokens at these spans; valid until the next call."""
        if self.count > self.store_words:
            self._clear()
        slots = (hashes >> self.shift).astype(np.int64)
        words = self.words[slots]
        missed = np.flatnonzero((self.keys[slots] != hashes) | (words < 0))
        if len(missed):
            distinct, sample, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            where, raw = missed[sample], data.tobytes()
            pieces = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            fresh = self._append(*self.encode_misses(pieces)).astype(np.int32)
            words[missed] = fresh[back]
            slot = slots[where]
            self.keys[slot], self.words[slot] = distinct, fresh
        return words

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all rows, first id of each row and the end)."""
        words, row_bounds = self.words_of(data, offsets)
        lengths = self.lengths[words].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[gather_spans(self.starts[words], lengths)], ends[row_bounds]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder; it outlives tasks, so later tasks find its cache filled."""
    return WordEncoder(path)


def encoded_rounds(encoder: WordEncoder, data: np.ndarray, offsets: np.ndarray):
    """(first row, rows, flat ids, id bounds) of whole rows, about `ROUND_BYTES` of text at a time.

    A longer text is cut where no pre-token can cross, so working memory stays bounded.
    """
    for lo, hi in row_rounds(offsets):
        begin, end = offsets[lo], offsets[hi]
        if end - begin <= 3 * ROUND_BYTES:
            yield lo, hi - lo, *encoder.ids_of(data[begin:end], offsets[lo : hi + 1] - begin)
            continue
        specials = any(data[begin:end].tobytes().find(s) >= 0 for s in encoder.splitter.specials)
        cuts = [begin, end] if specials else long_text_cuts(data, begin, end, ROUND_BYTES)
        parts = [encoder.ids_of(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate(parts)
        yield lo, 1, ids, np.array([0, len(ids)])
