"""Byte-level BPE encoding and decoding by batched array rounds.

Encoding: the bytes of many distinct pre-tokens lie in one flat symbol array. Each round looks
the neighbouring pairs up by binary search over the sorted pair keys, finds every word's lowest
rank and merges all its places at once; a merge only makes pairs of higher rank, so this gives
the library's result. Decoding: the bytes of every id come from one flat table.

Nulls and empty texts have no ids; ids that the vocabulary lacks decode to nothing; other columns
are kept, unless they have the name of the column that is added, which then replaces them.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.flat import gather_spans, row_rounds, text_bytes
from rubricon.llm.pretokens import WordEncoder, encoded_rounds

NO_RANK = np.int64(1 << 40)
#: Ids that one round of decoding takes; a longer text is gathered in several.
ROUND_IDS = 1 << 17


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are
    themselves, the others follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges as sorted pair keys, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, byte_of = spec["model"]["vocab"], printable_bytes()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in byte_of.items():
            self.byte_ids[byte] = vocab[char]
        texts = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        texts |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(texts) + 1
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(self.size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(self.size)), np.uint8)
        self.special_ids = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], NO_RANK), self.merged[at]

    def encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids in each) of pre-tokens, all merged together."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair], merged[pair] = self._look_up(symbols[pair], symbols[pair + 1])
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            lowest = np.minimum.reduceat(rank, begin)
            over = lowest == NO_RANK
            if over.any():
                gone = np.repeat(over, size)
                done.append((word[gone], symbols[gone]))
                live = ~gone
                symbols, word, rank, merged = symbols[live], word[live], rank[live], merged[live]
                lowest, size = lowest[~over], size[~over]
                if not len(symbols):
                    break
            at = self._apart(np.flatnonzero(rank == np.repeat(lowest, size)))
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            symbols, word, rank, merged, touched = (x[keep] for x in (symbols, word, rank, merged, touched))
            again = touched.copy()
            again[:-1] |= touched[1:]
            again = np.flatnonzero(again)
            rank[again] = NO_RANK
            again = again[again < len(word) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again], merged[again] = self._look_up(symbols[again], symbols[again + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int32)
        words, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words, kind="stable")
        return ids[order].astype(np.int32), np.bincount(words, minlength=len(pieces)).astype(np.int32)

    @staticmethod
    def _apart(at: np.ndarray) -> np.ndarray:
        """Of places next to each other (as in `aaa`) every second one, from the left."""
        if len(at) < 2 or not (np.diff(at) == 1).any():
            return at
        fresh = np.concatenate([[True], np.diff(at) != 1])
        run_start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        return at[(np.arange(len(at)) - run_start) % 2 == 0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the id spans; bytes that are no UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < self.size)
        safe = np.where(known, ids, 0)
        lengths = np.where(known, self.lengths[safe], 0)
        parts = [
            self.flat[gather_spans(self.starts[safe[lo : lo + ROUND_IDS]], lengths[lo : lo + ROUND_IDS])]
            for lo in range(0, len(ids), ROUND_IDS)
        ]
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[bounds].astype(np.int64)
        raw = data.tobytes()
        edges = offsets[offsets < len(data)]
        try:
            if (data[edges] & 0xC0 == 0x80).any():
                raise ValueError("a text begins inside a character")
            raw.decode()
        except ValueError:
            return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(offsets, offsets[1:])], pa.string())
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class MergeEncoder(WordEncoder):
    """The shared pre-token cache, filled by merge rounds instead of the library."""

    def __init__(self, path: str, *size: int):
        super().__init__(path, *size)
        self.vocabulary = vocabulary(path)

    def encode_misses(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        special = self.vocabulary.special_ids
        if not any(p in special for p in pieces):
            return self.vocabulary.encode_words(pieces)
        flat, lengths = self.vocabulary.encode_words([b"" if p in special else p for p in pieces])
        ends = np.cumsum(lengths)
        for k in [k for k, p in enumerate(pieces) if p in special][::-1]:
            flat = np.insert(flat, ends[k], special[pieces[k]])
            lengths[k] = 1
        return flat, lengths


@lru_cache(maxsize=2)
def merge_encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path, 20, 600_000)


def replaced_schema(df: DataFrame, name: str, kind: str):
    return df.drop(name).withColumn(name, F.lit(None).cast(kind)).schema


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a last column of that name, in place of any of the same name."""
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    names = [batch.schema.names[i] for i in kept]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [values], [*names, name])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of `text` as an array of int."""

    def run(batches):
        encoder = merge_encoder(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for lo, rows, flat, bounds in encoded_rounds(encoder, data, offsets):
                made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield with_column(batch.slice(lo, rows), ids, made)

    return df.mapInArrow(run, replaced_schema(df, ids, "array<int>"))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of `ids`."""

    def run(batches):
        table = vocabulary(tokenizer)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(ids)), 0), np.int64)
            for lo, hi in row_rounds(np.concatenate([[0], np.cumsum(sizes)]), ROUND_IDS):
                part = batch.slice(lo, hi - lo)
                values = np.asarray(part.column(ids).flatten().fill_null(-1), np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                yield with_column(part, text, table.decode(values, bounds))

    return df.mapInArrow(run, replaced_schema(df, text, "string"))
