"""Token counts by a map-side lookup in two tiers.

First tier: a compact table (hash, number of tokens) of frequent pre-tokens, broadcast. All
texts are counted: a pre-token with a share of `1/FREQUENT` of the corpus has that share in some
task, so each task proposes its common ones and only proposals are summed; the table has
`FREQUENT` entries at most, whatever the corpus. Second tier: a worker's cache in front of the library, for
misses. Pre-tokens themselves are never shuffled.

A null or empty text has no tokens. Rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.bpe import with_column
from rubricon.llm.flat import row_rounds, span_hash, sums_by_row, text_bytes
from rubricon.llm.pretokens import WordEncoder, encoded_rounds, load_tokenizer, word_encoder

FREQUENT = 1 << 14
SLOTS_LOG2 = 18


class Tally:
    """Counts of the common hashes of a task. Each round drops what has under a quarter of the
    share asked for, so at most that quarter is missing from any count in the end."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.total = 0

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Takes a round in; returns the hashes that were not yet known."""
        self.total += len(hashes)
        keys, counts = np.unique(hashes, return_counts=True)
        keep = counts * (4 * FREQUENT) >= len(hashes)
        known, fresh = self.counts, []
        for key, count in zip(keys[keep].tolist(), counts[keep].tolist()):
            if key in known:
                known[key] += count
            else:
                known[key] = count
                fresh.append(key)
        if len(known) > 16 * FREQUENT:
            self.counts = {k: c for k, c in known.items() if c * 8 * FREQUENT >= self.total}
        return np.array(fresh, np.uint64)

    def frequent(self) -> list[tuple[int, int]]:
        return [(k, c) for k, c in self.counts.items() if c * 4 * FREQUENT >= 3 * self.total]


def frequent_lengths(df: DataFrame, tokenizer: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, token counts) of the frequent pre-tokens of all texts, `FREQUENT` at most."""

    def run(batches):
        encoder, tally, seen = word_encoder(tokenizer), Tally(), {}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in row_rounds(offsets):
                part = data[offsets[lo] : offsets[hi]]
                bounds, _ = encoder.splitter.split(part, offsets[lo : hi + 1] - offsets[lo])
                starts, ends = bounds[:-1], bounds[1:]
                hashes = span_hash(part, starts, ends)
                fresh = tally.add(hashes)
                if len(fresh):
                    at = np.flatnonzero(np.isin(hashes, fresh))
                    for k in at[np.unique(hashes[at], return_index=True)[1]]:
                        seen[int(hashes[k])] = part[starts[k] : ends[k]].tobytes()
        rows = [(k, c, seen[k]) for k, c in tally.frequent() if len(seen[k]) < 256]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64), pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.binary()),
            ],
            ["hash", "n", "piece"],
        )

    proposals = df.select(text).mapInArrow(run, "hash long, n long, piece binary")
    top = (
        proposals.groupBy("hash")
        .agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
        .orderBy(F.desc("n"), "hash")
        .limit(FREQUENT)
        .collect()
    )
    pieces = [bytes(r["piece"]).decode() for r in top]
    lengths = [len(e.ids) for e in load_tokenizer(tokenizer).encode_batch(pieces, add_special_tokens=False)]
    return np.array([r["hash"] for r in top], np.int64).view(np.uint64), np.array(lengths, np.int32)


class TwoTier:
    """The broadcast table in front of a worker's encoder."""

    def __init__(self, encoder: WordEncoder, hashes: np.ndarray, lengths: np.ndarray):
        self.encoder, self.shift = encoder, np.uint64(64 - SLOTS_LOG2)
        self.keys, self.lengths = np.zeros(1 << SLOTS_LOG2, np.uint64), np.zeros(1 << SLOTS_LOG2, np.int32)
        slots = (hashes >> self.shift).astype(np.int64)[::-1]  # the most frequent one takes a shared slot
        self.keys[slots], self.lengths[slots] = hashes[::-1], lengths[::-1]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        bounds, rows = self.encoder.splitter.split(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        hashes = span_hash(data, starts, ends)
        slots = (hashes >> self.shift).astype(np.int64)
        lengths = self.lengths[slots].astype(np.int64)
        missed = np.flatnonzero((self.keys[slots] != hashes) | (lengths == 0))
        if len(missed):
            words = self.encoder.words_at(data, starts[missed], ends[missed], hashes[missed])
            lengths[missed] = self.encoder.lengths[words]
        return sums_by_row(lengths, rows)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of `text`; a column named `out` is replaced."""
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, tokenizer, text))

    def run(batches):
        encoder = word_encoder(tokenizer)
        lookup = TwoTier(encoder, *table.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi in row_rounds(offsets):
                begin, end = offsets[lo], offsets[hi]
                if hi - lo == 1 and end - begin > (8 << 20):  # worked on in several rounds
                    for _, _, ids, _ in encoded_rounds(encoder, data[begin:end], np.array([0, end - begin])):
                        counts[lo] = len(ids)
                else:
                    counts[lo:hi] = lookup.counts(data[begin:end], offsets[lo : hi + 1] - begin)
            yield with_column(batch, out, pa.array(counts, pa.int64()))

    schema = df.drop(out).withColumn(out, F.lit(0).cast("long")).schema
    return df.mapInArrow(run, schema)
