"""Byte-level BPE by ranks, over chunks of texts that overlap.

Encoding: a text is cut into chunks of `CHUNK_BYTES`, each reaching `OVERLAP_BYTES` into the next
one. Chunks are pre-tokenised apart from each other, whatever character they begin at. Where a
pre-token ends depends on what follows its beginning alone, so from the first place on that two
neighbouring chunks both have as a boundary, they agree: there, or at the next such place with no
white space before it, the text is stitched. The pieces between these places are encoded, again
apart, and their ids put together in order. A text in which some neighbours share no boundary (a pre-token longer than the overlap) takes another round
with chunks and overlaps four times as long, at most until it is a single chunk. A text no longer
than a chunk is a single chunk from the start and never moves.

Decoding: the bytes of every id come from one flat table and are concatenated.

A null or empty text has no ids, a null or empty list of ids decodes to no bytes; ids that the
ranks lack decode to nothing. Repeated rows stay. Other columns are kept, but for one with the
name of the added column, which is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.bpe import replaced_schema, with_column
from rubricon.llm.flat import gather_spans, row_rounds, text_bytes
from rubricon.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, UNKNOWN, Splitter, WordEncoder
from rubricon.session import stored

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 10
#: A boundary nearer to a chunk's cut end than this may be one of the chunk only.
UNSURE_BYTES = 16
#: Ids that one round of decoding takes.
ROUND_IDS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class PatternSplitter(Splitter):
    """Pre-token boundaries with the character classes of the tiktoken library, no special strings."""

    def __init__(self):
        single = {bytes([b]): b for b in range(256)}
        asked = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
        self.classes = [(kind, tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={})) for kind, p in asked]
        self.specials = []
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[:128] = [self._ask(c) for c in range(128)]

    def _ask(self, code: int) -> int:
        # What a pattern does not match gives no tokens.
        return next((kind for kind, one in self.classes if one.encode_ordinary(chr(code))), OTHER)

    def stitch_places(self, data: np.ndarray) -> np.ndarray:
        """The pre-token boundaries of one text that no white space stands before: white space is
        matched with a look at what follows, so what ends with it can't be encoded apart."""
        bounds = self.split(data, np.array([0, len(data)]))[0]
        if not len(data):
            return bounds
        at, kind = self._chars(data)
        before = (bounds if at is None else np.searchsorted(at, bounds)) - 1
        return bounds[(before < 0) | (kind[before] != SPACE)]


class RankEncoder(WordEncoder):
    """The cache of encoded pre-tokens, filled by the tiktoken library, one pre-token at a time."""

    def __init__(self, path: str, slots_log2: int = 20, store_words: int = 600_000):
        self.core = tiktoken.Encoding("ranks", pat_str=r"\s\S", mergeable_ranks=read_ranks(path), special_tokens={})
        self.splitter = PatternSplitter()
        self.shift, self.store_words = np.uint64(64 - slots_log2), store_words
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.words = np.full(1 << slots_log2, -1, np.int32)
        self._clear()

    def encode_misses(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.core._encode_single_piece(p) for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())), lengths


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """The worker's encoder; it outlives tasks."""
    return RankEncoder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all ids, where each id's begin, how many it has); the last id stands for unknown ones."""
    texts = {rank: token for token, rank in read_ranks(path).items()}
    size = max(texts) + 1
    lengths = np.array([len(texts.get(i, b"")) for i in range(size)] + [0], np.int64)
    flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
    return flat, np.cumsum(lengths) - lengths, lengths


def id_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def encoded(column_bytes, kept: list[str], column: str, ids: str, path: str):
    """A function over Arrow batches that adds the ids of a column to the columns `kept`."""

    def run(batches):
        encoder = rank_encoder(path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(column))
            rest = batch.select(kept)
            for lo, hi in row_rounds(offsets):
                begin, end = offsets[lo], offsets[hi]
                flat, bounds = encoder.ids_of(data[begin:end], offsets[lo : hi + 1] - begin)
                yield with_column(rest.slice(lo, hi - lo), ids, id_lists(flat, bounds))

    return run


def whole_characters(piece: bytes, at_begin: bool, at_end: bool) -> tuple[int, int]:
    """Where the whole characters of a chunk begin and end; at a cut end the last one is left out."""
    lo, hi = 0, len(piece)
    while not at_begin and lo < hi and piece[lo] & 0xC0 == 0x80:
        lo += 1
    if not at_end and hi > lo:
        hi -= 1
        while hi > lo and piece[hi] & 0xC0 == 0x80:
            hi -= 1
    return lo, hi


def chunk_edges(path: str, chunk: int, overlap: int):
    """Over chunks (key, no, at, size, piece): boundaries in the overlap with the chunk before
    (`head`) and, as far as they are sure, with the one behind (`tail`)."""

    def run(batches):
        splitter = rank_encoder(path).splitter
        for batch in batches:
            at, size = (np.asarray(batch.column(c), np.int64) for c in ("at", "size"))
            heads, tails = [], []
            for row, piece in enumerate(batch.column("piece")):
                raw = piece.as_buffer()
                begin, end = at[row], at[row] + raw.size
                lo, hi = whole_characters(memoryview(raw), begin == 0, end == size[row])
                data = np.frombuffer(raw, np.uint8)[lo:hi]
                bounds = splitter.stitch_places(data) + begin + lo
                sure = size[row] if end == size[row] else begin + hi - UNSURE_BYTES
                heads.append(bounds[(bounds <= begin + overlap) & (bounds <= sure)])
                tails.append(bounds[(bounds >= begin + chunk) & (bounds <= sure)])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "no", "size")] + lists, ["key", "no", "size", "head", "tail"])

    return run


def chunks_of(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, no, at, size, piece) of each text (key, text), dealt out by chunk."""
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    pieces = F.transform(
        F.sequence(F.lit(0), size - 1, F.lit(chunk)),
        lambda at: F.struct((at / chunk).cast("int").alias("no"), at.alias("at"), size.alias("size"), F.substring(raw, at + 1, F.lit(chunk + overlap)).alias("piece")),
    )
    return texts.select("key", F.inline(pieces)).repartition("key", "no")


def stitches(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, no, begin, end) of the pieces; `begin` is null where a chunk meets the one before nowhere."""
    edges = chunks.mapInArrow(chunk_edges(path, chunk, overlap), "key long, no int, size int, head array<long>, tail array<long>")
    order = Window.partitionBy("key").orderBy("no")
    meet = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    cut = edges.select("key", "no", "size", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(meet).alias("begin"))
    last = F.lead("no").over(order).isNull()
    return cut.select("key", "no", "begin", F.when(last, F.col("size")).otherwise(F.lead("begin").over(order)).alias("end"))


def stitched_ids(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of long texts (key, text)."""
    found = None
    while True:
        chunks = chunks_of(texts, chunk, overlap)
        cuts = stored(stitches(chunks, path, chunk, overlap), "stitches")
        apart = cuts.filter("begin is null").select("key").distinct()
        more = not apart.isEmpty()
        if more:
            cuts = cuts.join(apart, "key", "left_anti")
        pieces = chunks.join(cuts, ["key", "no"]).select(
            "key", "no", F.expr("substring(piece, cast(begin - at + 1 as int), cast(end - begin as int))").alias("piece")
        )
        run = encoded(binary_bytes, ["key", "no"], "piece", "ids", path)
        parts = pieces.mapInArrow(run, "key long, no int, ids array<int>")
        ids = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts")).select("key", F.flatten("parts.ids").alias("ids"))
        found = ids if found is None else found.unionByName(ids)
        if not more:
            return found
        texts, chunk, overlap = texts.join(apart, "key", "left_semi"), 4 * chunk, 4 * overlap


def encode(
    df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES
) -> DataFrame:
    """The columns `keep` (None: all) and the ids of `text` by the rank file `ranks` as an array of int.

    `df` is read twice, once for the texts of a single chunk and once for longer ones; the latter
    are written to shared storage with a key before they are cut."""
    keep = [c for c in (keep or df.columns) if c.lower() != ids.lower()]
    df, size = df.select(*dict.fromkeys([*keep, text])), F.coalesce(F.octet_length(text), F.lit(0))
    schema = replaced_schema(df.select(keep), ids, "array<int>")
    short = df.filter(size <= chunk).mapInArrow(encoded(text_bytes, keep, text, ids, ranks), schema)
    key = "key"
    while key.lower() in (c.lower() for c in [*df.columns, ids]):
        key = f"_{key}"
    long = stored(df.filter(size > chunk).withColumn(key, F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        return short
    found = stitched_ids(long.select(F.col(key).alias("key"), F.col(text).alias("text")), ranks, chunk, overlap)
    joined = long.join(found.select(F.col("key").alias(key), F.col("ids").alias(ids)), key)
    return short.unionByName(joined.select(short.columns))


def packed_ids(column: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Id lists as little-endian unsigned 32-bit integers, one binary value each."""
    raw = np.asarray(column.flatten().fill_null(0)).astype("<u4").tobytes()
    offsets = 4 * np.concatenate([[0], np.cumsum(sizes)])
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return made.cast(pa.binary())


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded", packed: str | None = None) -> DataFrame:
    """Adds the bytes of `ids`, put one behind the other; with `packed`, also the ids in their packed form under that name."""

    def run(batches):
        flat, starts, lengths = byte_table(ranks)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(ids)), 0), np.int64)
            for lo, hi in row_rounds(np.concatenate([[0], np.cumsum(sizes)]), ROUND_IDS):
                part = batch.slice(lo, hi - lo)
                values = np.asarray(part.column(ids).flatten().fill_null(-1), np.int64)
                values = np.where((values >= 0) & (values < len(lengths)), values, len(lengths) - 1)
                takes = lengths[values]
                rounds = [slice(k, k + ROUND_IDS) for k in range(0, len(values), ROUND_IDS)]
                data = b"".join(flat[gather_spans(starts[values[r]], takes[r])].tobytes() for r in rounds)
                offsets = np.concatenate([[0], np.cumsum(takes)])[np.concatenate([[0], np.cumsum(sizes[lo:hi])])].astype(np.int64)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                part = with_column(part, out, made.cast(pa.binary()))
                yield part if packed is None else with_column(part, packed, packed_ids(part.column(ids), sizes[lo:hi]))

    schema = replaced_schema(df, out, "binary")
    return df.mapInArrow(run, schema if packed is None else replaced_schema(df.drop(out).withColumn(out, F.lit(None).cast("binary")), packed, "binary"))
