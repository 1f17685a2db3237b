"""Packing of documents into training sequences by lexical retrieval.

Documents are encoded once and stored; document frequencies of all ids are counted over the whole
corpus on the way. A range partitioning by a lexical key (minimum hashes of the document's ids and
pre-tokens, then doc_id, so that a crowd of copies is still split) deals them to tasks, and each
task cuts its stream into index shards of bounded size. A shard has a BM25 inverted index. The
document at the start of a window is its seed: its best unused neighbours follow until the window
is full, and the last one is cut there; what remains of it opens the next window and is its
seed. Only the last sequence of a task is padded.

Nulls and empty texts are the end id alone. Repeated rows are packed each for itself. Other
columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.flat import text_bytes
from rubricon.llm.pretokens import encoded_rounds, load_tokenizer, word_encoder
from rubricon.session import stored

K1, B = 1.2, 0.75
#: Terms of a seed that are looked up: those with the largest BM25 weight.
QUERY_TERMS = 16
#: Neighbours ranked for a seed at a time; a seed that needs more is asked again.
RANKED = 64
#: An index shard is closed once it has so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 21, 1 << 12

ENCODED = "doc_id long, n int, near long, nearer long, ids binary, counts binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def row_minimum(values: np.ndarray, bounds: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.minimum.reduceat(values, bounds[full])
    return out


def doc_terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, occurrences) of every distinct id of each document, in that order."""
    rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    keys = np.sort(rows << np.uint64(32) | ids.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def stored_ids(tokenizer: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    return np.dtype("<u2" if load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")


def encoded(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents with ids and lexical key; each task adds one row (n = -1) with its counts of
    documents and ids and its document frequencies."""

    def run(batches):
        encoder, kind = word_encoder(tokenizer), stored_ids(tokenizer)
        size = encoder.tokenizer.get_vocab_size()
        frequency, docs, tokens = np.zeros(size, np.int64), 0, 0
        names = ["doc_id", "n", "near", "nearer", "ids", "counts"]

        for batch in batches:
            doc_ids = batch.column(0)
            for lo, n, ids, bounds in encoded_rounds(encoder, *text_bytes(batch.column(1))):
                ids = np.insert(ids, bounds[1:], end_id).astype(np.int64)
                bounds = bounds + np.arange(n + 1)
                doc, term, _ = doc_terms(ids, bounds)
                frequency += np.bincount(term, minlength=size)
                docs, tokens = docs + n, tokens + len(ids)
                # Pairs of neighbouring ids stand for words in the finer key.
                hashed = (ids * 0x9E3779B1 >> 7) & 0xFFFFFFFF
                pairs = ((ids * 0x85EBCA6B ^ np.append(ids[1:], 0) * 0xC2B2AE35) >> 5) & 0xFFFFFFFF
                offsets = pa.py_buffer((bounds * kind.itemsize).astype(np.int32))
                made = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(ids.astype(kind).tobytes())])
                columns = [
                    doc_ids.slice(lo, n),
                    pa.array(np.diff(bounds), pa.int32()),
                    pa.array(row_minimum(hashed, bounds, 0), pa.int64()),
                    pa.array(row_minimum(pairs, bounds, 0), pa.int64()),
                    made,
                    pa.nulls(n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
        head = np.array([docs, tokens], "<i8").tobytes()
        last = [[None], [-1], [0], [0], [None], [head + frequency.astype("<i8").tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(last, kinds)], names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def corpus_counts(table: DataFrame) -> np.ndarray:
    """[documents, ids, document frequency of each id...] of the whole corpus; as long as the
    vocabulary, so it may be broadcast."""

    def run(batches):
        total = None
        for batch in batches:
            for value in batch.column(0):
                one = np.frombuffer(value.as_py(), "<i8")
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "counts"])

    rows = table.filter("n = -1").select("counts")
    parts = rows.coalesce(64).mapInArrow(run, "key int, counts binary")
    got = [np.frombuffer(r["counts"], "<i8") for r in parts.select("counts").collect()]
    return np.sum(got, axis=0) if got else np.zeros(2, np.int64)


class Shard:
    """A BM25 inverted index over the ids of some documents."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, counts: np.ndarray):
        self.n = len(bounds) - 1
        self.sizes = np.diff(bounds)
        doc, term, times = doc_terms(ids, bounds)
        n_docs, mean = max(1, counts[0]), counts[1] / max(1, counts[0])
        df = counts[2:][term]
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        weight = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * self.sizes[doc] / max(mean, 1)))
        order = np.lexsort((-weight, doc))
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = order[place < QUERY_TERMS]
        self.query_bounds = np.searchsorted(doc[top], np.arange(self.n + 1))
        by_term = np.argsort(term, kind="stable")
        self.posting_docs, self.posting_weights = doc[by_term], weight[by_term]
        sorted_terms = term[by_term]
        self.query_from = np.searchsorted(sorted_terms, term[top], "left")
        self.query_to = np.searchsorted(sorted_terms, term[top], "right")
        self.used = np.zeros(self.n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first; ties in key order."""
        span = range(self.query_bounds[seed], self.query_bounds[seed + 1])
        cuts = [slice(self.query_from[k], self.query_to[k]) for k in span]
        if not cuts:
            return np.zeros(0, np.int64)
        docs = np.concatenate([self.posting_docs[c] for c in cuts])
        scores = np.bincount(docs, np.concatenate([self.posting_weights[c] for c in cuts]), self.n)
        scores[self.used] = 0
        best = np.argpartition(-scores, RANKED)[:RANKED] if self.n > RANKED else np.arange(self.n)
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))]


def packed_order(shard: Shard, window: int, filled: int) -> tuple[list[int], int]:
    """(documents in the order in which they fill windows, how full the last window is)."""
    order, next_free, sizes, used = [], 0, shard.sizes.tolist(), shard.used
    seed, ranked, at = -1, np.zeros(0, np.int64), 0
    while len(order) < shard.n:
        if seed >= 0 and at == len(ranked):
            ranked, at = shard.neighbours(seed), 0
        while at < len(ranked) and used[ranked[at]]:
            at += 1
        if at < len(ranked):
            doc, at = int(ranked[at]), at + 1
        else:
            while used[next_free]:
                next_free += 1
            doc = seed = next_free
            ranked, at = np.zeros(0, np.int64), 0
        used[doc] = True
        order.append(doc)
        filled += sizes[doc]
        if filled >= window:  # the rest of the cut document is the next window's seed
            filled %= window
            seed, ranked, at = (doc if filled else -1), np.zeros(0, np.int64), 0
    return order, filled


def pack(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document in a sequence of `window` ids; a sequence's ids are
    gapless from offset 0 and all but the last of each task are full. `ids` holds the piece's ids
    as little-endian unsigned 32-bit integers."""
    table = stored(encoded(df, tokenizer, end_id), "encoded")
    counts = df.sparkSession.sparkContext.broadcast(corpus_counts(table))

    def shard_rows(doc_ids: list, parts: list[np.ndarray], sequence: int, filled: int):
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        order, _ = packed_order(Shard(np.concatenate(parts), bounds, counts.value), window, filled)
        order = np.array(order)
        ends = np.cumsum(sizes[order]) + filled
        begins = ends - sizes[order]
        # Cut the stream at every multiple of the window.
        n_pieces = (ends - 1) // window - begins // window + 1
        doc = np.repeat(np.arange(len(order)), n_pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        left = np.maximum(begins[doc], (begins[doc] // window + nth) * window)
        right = np.minimum(ends[doc], (begins[doc] // window + nth + 1) * window)
        stream = np.concatenate([parts[k] for k in order]).astype("<u4")
        offsets = np.append(left - filled, ends[-1] - filled) * 4
        ids = pa.BinaryArray.from_buffers(
            pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(stream.tobytes())]
        )
        names = pa.array([doc_ids[k] for k in order], pa.int64())
        columns = [
            names.take(pa.array(doc)),
            pa.array(left - begins[doc]),
            pa.array(right - left),
            ids,
            pa.array(sizes[order][doc]),
            pa.array(sequence + left // window),
            pa.array(left % window),
        ]
        fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        end = int(ends[-1])
        return pa.RecordBatch.from_arrays(columns, fields), sequence + end // window, end % window

    def run(batches):
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        docs, parts, held, kind = [], [], 0, stored_ids(tokenizer)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(name)
                parts.append(np.frombuffer(value.as_buffer(), kind).astype(np.int64))
                held += len(parts[-1])
                if held >= SHARD_IDS or len(docs) >= SHARD_DOCS:
                    rows, sequence, filled = shard_rows(docs, parts, sequence, filled)
                    yield rows
                    docs, parts, held = [], [], 0
        if docs:
            yield shard_rows(docs, parts, sequence, filled)[0]

    keys = ["near", "nearer", "doc_id"]
    return (
        table.filter("n >= 0")
        .select("doc_id", "ids", "near", "nearer")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "ids")
        .mapInArrow(run, PIECES)
    )
