"""Token files: frequency-ranked ids in byte-aligned code with separate control bytes.

A file is one shard of the documents in ascending doc_id order, cut into blocks of whole
documents. A block replaces each id by its rank (0 is the block's most frequent id), writes a
rank in one to four little-endian bytes, and keeps the sizes apart: two bits a rank, four ranks
in a control byte. Reading looks each control byte up in a table of sizes and gathers the bytes;
there is no loop over ids. The blocks are rows of Parquet files, so Spark's own committer makes
writing safe against lost executors and any store will do.

Null texts and empty texts hold the end id alone. Null doc_ids come first. Rows with the same
doc_id stay apart, in the order of their text's hash. Other columns are not written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubricon.llm.flat import text_bytes, windows64
from rubricon.llm.pretokens import encoded_rounds, word_encoder

#: A block is closed once it has so many ids.
BLOCK_IDS = 1 << 19

BLOCK_SCHEMA = (
    "shard int, block int, ids_before long, doc_ids array<long>, lengths array<int>, "
    "ranked binary, control binary, data binary"
)
_SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids by rank as uint32, control bytes, data bytes)."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids].astype("<u4")
    sizes = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    codes = np.zeros((len(ids) + 3) // 4 * 4, np.uint8)
    codes[: len(ids)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return ranked.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ids of a block, as uint32."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    ranks = windows64(np.frombuffer(data, np.uint8))[starts] & _MASKS[sizes]
    return np.frombuffer(ranked, "<u4")[ranks.astype(np.int64)]


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the ids of every document, each followed by `end_id`, in ascending doc_id order."""

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        encoder, docs, lengths, parts, held = word_encoder(tokenizer), [], [], [], 0

        def closed():
            ids = np.concatenate(parts)
            row = [[shard], [block], [before], [docs], [lengths], *([x] for x in encode_block(ids))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            names = ["shard", "block", "ids_before", "doc_ids", "lengths", "ranked", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, n, ids, bounds in encoded_rounds(encoder, *text_bytes(batch.column(1))):
                ids = np.insert(ids, bounds[1:], end_id)  # after each document's last id
                docs += names[lo : lo + n]
                lengths += (np.diff(bounds) + 1).tolist()
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield closed()
                    before += held
                    block, held, docs, lengths, parts = block + 1, 0, [], [], []
        if docs:
            yield closed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    (
        df.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(run, BLOCK_SCHEMA)
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens and
    `ids` (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = sum(row["lengths"])
                ids = decode_block(row["ranked"], row["control"], row["data"], n).astype("<u4")
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - row["lengths"]
                made = pa.BinaryArray.from_buffers(
                    pa.binary(),
                    len(ends),
                    [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["ids_before"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        made,
                    ],
                    ["shard", "doc_id", "start", "n_tokens", "ids"],
                )

    docs = blocks.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids binary")
    # One row for each file: the ids in all files before it.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
