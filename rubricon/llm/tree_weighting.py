"""Language-model scoring by context-tree weighting.

A text is its words, each a string of bytes with an end symbol, and one empty word at the end of
the text. A byte is eight binary decisions; each decision has a context tree over the bytes before
it in its text (nearest first, back to the text's beginning, `DEPTH` at most), ends of words
included; on request contexts end at the word's beginning. A node estimates its bit by
Krichevsky-Trofimov, and mixes that with what its children say, for all depths at once: its weight
is the posterior that the tree ends there, from the block probabilities of everything counted.
After training the tree is frozen, so the probability of a symbol depends on its context alone. A
path ends at the deepest node that training texts have visited.

There is one tree for all training texts, and one for the texts of each of the `KINDS` commonest
kinds (languages, say), where a kind is given: a text's probability is the mixture of what the
trees give it, weighted by their shares of training texts, so the kind of the scored text is not
looked at.

All training texts are counted and every node that they visit is kept: the trees grow with the
input and are never in one place. Texts lie in chunks. A chunk sends each of its distinct events (a
context and the symbol in it) once, with its counts by kind, to the group of contexts that share
the two nearest bytes. Groups sum the counts, are written with what was asked of them, work out
their trees below depth 1 and send each chunk the log probabilities of its events, which the chunk
sums by text; only the nodes of depth 0 and 1 (65,792 for each kind at most) are summed on the
driver and broadcast. A group holds distinct contexts of `DEPTH` bytes of each chunk, however often
they occur there. What is sent goes by the distinct events of the chunks, so large chunks send less.

Word counts go the same way: a chunk's distinct words are summed over all chunks, in buckets of
words, of which there are as many as chunks, and sent back.

Nulls, empty and white texts are one end symbol. Rows are kept as they are, repeated ones too.
Columns other than doc_id, text and the training flag are not used. A text's words are cut whole,
a word of any length counts as one.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm.flat import gather_spans, lower_ascii, row_rounds, span_hash, text_bytes, word_spans
from rubricon.session import stored

DEPTH = 6
#: Kinds of text that get a tree of their own.
KINDS = 8
#: Text bytes that ask for their contexts together, about; a longer text is a chunk of its own.
CHUNK_BYTES = 48 << 20
#: Text bytes that are frozen and worked on together.
ROW_BYTES = 1 << 18
#: Events or words that a chunk holds unsummed.
EVENT_ROWS = 1 << 20
#: Events of a group, times trees, that are worked on together.
GROUP_EVENTS = 1 << 16
#: Rows of packed bytes that go to Python together; the default of 10,000 is a whole chunk and more.
BATCH_ROWS = 64
#: Answers that leave a task together, about.
ANSWER_BYTES = 1 << 22
#: The end symbol, and what stands before the first byte of a context's text; neither is in a word.
END, START = 0x20, 0x0A
#: In place of a kind: texts that teach nothing.
NOTHING = 255


def log_gamma(x: np.ndarray) -> np.ndarray:
    shifted, fix = x.astype(float), 0.0
    for _ in range(6):
        fix, shifted = fix + np.log(shifted), shifted + 1
    inv = 1 / shifted
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - fix


#: `log_gamma` of small counts and a half, and of small counts and one.
GAMMA_HALF, GAMMA_ONE = (log_gamma(np.arange(1 << 12) + add) for add in (0.5, 1.0))


def log_gamma_of(counts: np.ndarray, add: float, small: np.ndarray) -> np.ndarray:
    """`log_gamma` of whole counts and `add`, from its table where that has it."""
    found = small[np.minimum(counts, len(small) - 1).astype(np.int64)]
    large = np.flatnonzero(counts >= len(small))
    if len(large):
        found[large] = log_gamma(counts[large] + add)
    return found


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    ones_and_zeros = log_gamma_of(n0, 0.5, GAMMA_HALF) + log_gamma_of(n1, 0.5, GAMMA_HALF)
    return ones_and_zeros - log_gamma_of(n0 + n1, 1.0, GAMMA_ONE) - math.log(math.pi)


def text_events(data: np.ndarray, offsets: np.ndarray, across_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol of every byte and end in the words of lower-cased texts, first event of
    each text). The lowest byte is the symbol, the byte below the highest (a kind's) the nearest of
    the context; behind the beginning, START, are zeros."""
    starts, ends, bounds = word_spans(data, offsets)
    lengths = ends - starts
    sizes = np.insert(lengths, bounds[1:], 0) + 1  # every word and the empty one, with END
    begin = np.cumsum(sizes) - sizes
    first = begin[bounds[:-1] + np.arange(len(bounds) - 1)]
    line = np.full(int(sizes.sum()), END, np.uint8)
    words = np.delete(begin, bounds[1:] + np.arange(len(bounds) - 1))
    line[gather_spans(words, lengths)] = data[gather_spans(starts, lengths)]
    key = line.astype(np.uint64)
    for back in range(1, DEPTH + 1):
        key[back:] |= line[:-back].astype(np.uint64) << np.uint64(56 - 8 * back)
    units = first if across_words else begin
    lasts = np.append(units[1:], len(line))
    for nth in range(DEPTH):
        at = units[units + nth < lasts] + nth
        kept = np.uint64(255 | (((1 << (8 * nth)) - 1) << (56 - 8 * nth)))
        key[at] = key[at] & kept | np.uint64(START << (48 - 8 * nth))
    return key, first


def context_sizes(events: np.ndarray) -> np.ndarray:
    """Bytes of context of each event: up to its beginning, DEPTH at most."""
    sizes = np.full(len(events), DEPTH, np.int64)
    for back in range(DEPTH, 0, -1):
        sizes[(events >> np.uint64(56 - 8 * back)) & np.uint64(255) == START] = back
    return sizes


def entry_keys(events: np.ndarray, depth: int) -> np.ndarray:
    """Kind, nearest `depth` context bytes and symbol of each event. Entries in ascending order
    have the entries of any node (a context and the first bits of a symbol) side by side."""
    return (events >> np.uint64(56 - 8 * depth)) << np.uint64(8) | events & np.uint64(255)


def weighted(keys, zeros, ones, depth: int, below: tuple[np.ndarray, np.ndarray] | None, leaf=None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each node's own estimate, log of its weighted probability). `below`: parent key
    and weighted log probability of the nodes one level deeper. `leaf`: contexts that end here."""
    own = kt_block(zeros, ones)
    leaf = np.full(len(keys), depth == DEPTH) if leaf is None else leaf
    children = np.zeros(len(keys))
    if below is not None and len(below[0]):
        at = np.searchsorted(keys, below[0])
        children = np.bincount(at, below[1], len(keys))
    total = np.where(leaf, own, np.logaddexp(own, children) - math.log(2))
    return np.where(leaf, 1.0, np.exp(own - math.log(2) - total)), total


class Level:
    """The nodes of one depth: `entries` in ascending order, `node[:, bit]` the node in which each
    entry's bit is decided; by node its zeros and ones, and the entry that it was first met in."""

    def __init__(self, events: np.ndarray, counts: np.ndarray, depth: int):
        self.depth = depth
        self.entries, at = np.unique(entry_keys(events, depth), return_inverse=True)
        times, n = np.bincount(at, counts, len(self.entries)), 0
        self.node = np.zeros((len(self.entries), 8), np.int64)
        zeros, ones, first, bits = [], [], [], []
        for bit in range(8):
            node = self.entries >> np.uint64(8 - bit)
            begins = np.flatnonzero(np.append(True, node[1:] != node[:-1]))[: len(node)]
            place = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(node))))
            one = (self.entries >> np.uint64(7 - bit)) & np.uint64(1)
            ones.append(np.bincount(place, times * one, len(begins)))
            zeros.append(np.bincount(place, times, len(begins)) - ones[-1])
            self.node[:, bit] = place + n
            first.append(begins)
            bits.append(np.full(len(begins), bit))
            n += len(begins)
        self.zeros, self.ones, self.first, self.bit = map(np.concatenate, (zeros, ones, first, bits))

    def weigh(self, below: Level | None) -> None:
        """Sets weight and total of the nodes from the level one deeper."""
        last = (self.entries[self.first] >> np.uint64(8)) & np.uint64(255)
        leaf = (last == START) if 0 < self.depth < DEPTH else np.full(len(last), self.depth == DEPTH)
        under = None
        if below is not None:
            # An entry of the deeper level belongs to the entry with its context's last byte off.
            shorter = (below.entries >> np.uint64(16)) << np.uint64(8) | below.entries & np.uint64(255)
            entry = np.searchsorted(self.entries, shorter)
            under = (self.node[entry[below.first], below.bit], below.total)
        self.weight, self.total = weighted(np.arange(len(self.zeros)), self.zeros, self.ones, self.depth, under, leaf)
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry that shares most with each wanted one, bits in which they agree; -1 where no entry
        has its context). Of all entries, one of the two neighbours in order shares most."""
        right = np.searchsorted(self.entries, wanted)
        best, shared = np.zeros(len(wanted), np.int64), np.full(len(wanted), -1)
        for at in (np.minimum(right, len(self.entries) - 1), np.maximum(right - 1, 0)):
            differs = self.entries[at] ^ wanted
            agree = np.where(differs >> np.uint64(8) == 0, 8 - BIT_LENGTH[(differs & np.uint64(255)).astype(np.int64)], -1)
            best, shared = np.where(agree > shared, at, best), np.maximum(agree, shared)
        return best, shared


BIT_LENGTH = np.array([x.bit_length() for x in range(256)])


def group_levels(events: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Depths 2 to DEPTH of the contexts of whole groups, weights and all; levels without contexts
    are left out (none is deeper then)."""
    sizes, levels = context_sizes(events), []
    for depth in range(2, DEPTH + 1):
        deep = sizes >= depth
        if not deep.any():
            break
        levels.append(Level(events[deep], counts[deep], depth))
    for k in range(len(levels) - 1, -1, -1):
        levels[k].weigh(levels[k + 1] if k + 1 < len(levels) else None)
    return levels


def top_place(kind: np.ndarray, near: np.ndarray, symbol: np.ndarray, bit: int) -> np.ndarray:
    """Place of a node of depth 1 in an array of (kind, nearest byte, bits so far behind a one)."""
    so_far = (1 << bit) | (symbol.astype(np.int64) >> (8 - bit))
    return (kind.astype(np.int64) << 16) | near.astype(np.int64) << 8 | so_far


def pieces_of(events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, nearest byte, symbol) of events."""
    low = np.uint64(255)
    return events >> np.uint64(56), (events >> np.uint64(48)) & low, events & low


def below_top(events: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, zeros, ones, total of its children) of the depth 1 nodes of some whole groups."""
    places, zeros, ones, totals = [], [], [], []
    for level in group_levels(events, counts)[:1]:
        entry = level.entries[level.first]
        kind, near = entry >> np.uint64(24), (entry >> np.uint64(16)) & np.uint64(255)
        for bit in range(8):
            here = level.bit == bit
            places.append(top_place(kind[here], near[here], entry[here] & np.uint64(255), bit))
            zeros.append(level.zeros[here])
            ones.append(level.ones[here])
            totals.append(level.total[here])
    flat = context_sizes(events) == 1
    if flat.any():
        kind, near, symbol = pieces_of(events[flat])
        for bit in range(8):
            is_one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(float)
            places.append(top_place(kind, near, symbol, bit))
            ones.append(counts[flat] * is_one)
            zeros.append(counts[flat] * (1 - is_one))
            totals.append(np.zeros(int(flat.sum())))
    keys, at = np.unique(np.concatenate(places), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate(x), len(keys)) for x in (zeros, ones, totals))


class Top:
    """Depths 0 and 1 of all trees: visits, estimate and weight of every node, as dense arrays."""

    def __init__(self, place: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray, kinds: int):
        self.levels = []
        size = kinds << 16
        zeros, ones, children = (np.bincount(place, x, size) for x in (zeros, ones, children))
        near, nodes = (np.arange(size) >> 8) & 255, np.arange(size)
        weight, total = weighted(nodes, zeros, ones, 1, (nodes, children), near == START)
        self._keep(zeros, ones, weight)
        root = (nodes >> 16 << 8) | (nodes & 255)
        total = np.where(zeros + ones > 0, total, 0.0)
        zeros, ones = (np.bincount(root, x, kinds << 8) for x in (zeros, ones))
        weight, _ = weighted(np.arange(kinds << 8), zeros, ones, 0, (root, total))
        self._keep(zeros, ones, weight)

    def _keep(self, zeros, ones, weight):
        self.levels.append((zeros + ones > 0, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), weight.astype(np.float32)))

    def mixed(self, events: np.ndarray, under: np.ndarray) -> np.ndarray:
        """Probability of a one in each of the events' eight decisions, `under` from depth 2 (NaN
        where the tree does not go that far)."""
        kind, near, symbol = pieces_of(events)
        out = np.empty_like(under)
        for bit in range(8):
            one, at = under[:, bit], top_place(kind, near, symbol, bit)
            for level, place in zip(self.levels, (at, (at >> 16 << 8) | (at & 255))):
                there, own, weight = (x[place] for x in level)
                one = np.where(there, np.where(np.isnan(one), own, weight * own + (1 - weight) * one), one)
            out[:, bit] = np.where(np.isnan(one), 0.5, one)
        return out


def event_logs(wanted: np.ndarray, levels: list[Level], top: Top) -> np.ndarray:
    """Log10 probability of the symbol of each wanted event (kind included) in its context."""
    path, at, sizes = [], np.arange(len(wanted)), context_sizes(wanted)
    for level in levels:
        at = at[sizes[at] >= level.depth]
        entry, shared = level.find(entry_keys(wanted[at], level.depth))
        at, entry, shared = at[shared >= 0], entry[shared >= 0], shared[shared >= 0]
        if not len(at):
            break
        path.append((level, at, entry, shared))
    one = np.full((len(wanted), 8), np.nan)
    for level, at, entry, shared in reversed(path):
        node, under = level.node[entry], one[at]
        own, weight = level.one[node], level.weight[node]
        mixed = np.where(np.isnan(under), own, weight * own + (1 - weight) * under)
        one[at] = np.where(np.arange(8) <= shared[:, None], mixed, under)
    one = top.mixed(wanted, one)
    is_one = (wanted[:, None] >> np.arange(7, -1, -1).astype(np.uint64)) & np.uint64(1) == 1
    return np.log10(np.where(is_one, one, 1 - one)).sum(axis=1)


def string_array(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    flat = data[gather_spans(starts, lengths)]
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(flat.tobytes()))


def pack(values: np.ndarray) -> bytes:
    """The bytes of numbers, first bytes before second ones, compressed: what neighbours share
    takes no room."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes | pa.Buffer, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting: `np.unique` hashes, which takes longer."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


class Places:
    """Finds numbers in an array by two tables of hashes, the rest by search. Of equal ones it finds
    any."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            shift = np.uint64(63 - max(1, len(left)).bit_length())
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            parts = [left[lo : lo + (1 << 17)] for lo in range(0, len(left), 1 << 17)]
            slots_of = lambda part: ((keys[part] * np.uint64(salt)) >> shift).astype(np.int64)  # noqa: B023, E731
            for part in parts:
                table[slots_of(part)] = part
            self.tables.append((np.uint64(salt), shift, table))
            left = np.concatenate([np.zeros(0, np.int32), *[part[table[slots_of(part)] != part] for part in parts]])
        self.rest = left[np.argsort(keys[left])]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted number, all of which are there."""
        at = missed = None
        for salt, shift, table in self.tables:
            asked = wanted if at is None else wanted[missed]
            found = table[((asked * salt) >> shift).astype(np.int64)]
            wrong = np.flatnonzero(self.keys[found] != asked)
            if at is None:
                at, missed = found, wrong
            else:
                at[missed], missed = found, missed[wrong]
        if len(missed):
            at[missed] = self.rest[np.searchsorted(self.keys[self.rest], wanted[missed])]
        return at


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What is written within goes to Python by `BATCH_ROWS`."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(rows: bytes | pa.Buffer) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows, lower-cased bytes of their texts, offsets)."""
    table = pa.ipc.open_stream(rows).read_all()
    data, offsets = text_bytes(table["text"])
    return table, lower_ascii(data), offsets


def in_chunks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, rows) of the texts (doc_id, training, kind, text): neighbouring rows frozen together;
    and about how many chunks. Small partitions are read together, large ones are cut."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = text_bytes(batch.column(3))
            for lo, hi in row_rounds(offsets, ROW_BYTES):
                more = int(offsets[hi] - offsets[lo]) + hi - lo
                if held and held + more > CHUNK_BYTES * 5 // 4:
                    chunk, held = chunk + 1, 0
                held += more
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([frozen(batch.slice(lo, hi - lo))], pa.binary())], ["chunk", "rows"])

    docs = docs.select("doc_id", "training", "kind", "text").coalesce(size // CHUNK_BYTES + 1)
    return stored(docs.mapInArrow(run, "chunk long, rows binary"), "chunks"), size // CHUNK_BYTES + 1


def slices_of(keys: np.ndarray):
    """Ranges of neighbours with the same key."""
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return list(zip(cuts, np.append(cuts[1:], len(keys))))


def by_chunk(batches, held_of, merged, out):
    """What `out` makes of all `held_of` of a chunk's frozen rows, which `merged` sums."""
    at, held, size = None, [], 0
    for batch in batches:
        for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and chunk != at:
                found, held, size = merged(held), [], 0
                yield from out(at, found)
            at = chunk
            held.append(held_of(*thawed(rows.as_buffer())))
            size += len(held[-1][0])
            if size > EVENT_ROWS:
                held, size = [merged(held)], 0
    if held:
        found, held = merged(held), []
        yield from out(at, found)


def word_line(words: pa.Array) -> np.ndarray:
    """Words, each with END behind it."""
    data, offsets = text_bytes(words)
    lengths = np.diff(offsets)
    line = np.full(len(data) + len(lengths), END, np.uint8)
    line[gather_spans(offsets[:-1] + np.arange(len(lengths)), lengths)] = data
    return line


def line_spans(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a line."""
    ends = np.flatnonzero(line == END)
    return np.append(0, ends + 1)[:-1], ends


def asked_words(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, n, size, words, counts) of frozen texts: the n distinct words of a chunk in a
    bucket (by hash), and how often the texts that teach have them."""

    def held_of(table, data, offsets):
        starts, ends, bounds = word_spans(data, offsets)
        teaches = np.repeat(np.asarray(table["kind"]) != NOTHING, np.diff(bounds))
        hashes, first, at = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        return hashes, string_array(data, starts[first], (ends - starts)[first]), np.bincount(at, teaches, len(first))

    def merged(held):
        hashes, words, times = zip(*held)
        hashes, first, at = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        return hashes, pa.concat_arrays(words).take(pa.array(first)), np.bincount(at, np.concatenate(times), len(first))

    def out(chunk, found):
        hashes, words, times = found
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        for lo, hi in slices_of(bucket):
            line = word_line(words.slice(lo, hi - lo))
            row = [int(bucket[lo]), chunk, int(hi - lo), len(line), pack(line), pack(times[lo:hi].astype(np.uint32))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

    schema = pa.schema({"bucket": pa.int32(), "chunk": pa.int64(), "n": pa.int64(), "size": pa.int64(), "words": pa.binary(), "counts": pa.binary()})
    return texts.mapInArrow(lambda batches: by_chunk(batches, held_of, merged, out), "bucket int, chunk long, n long, size long, words binary, counts binary")


def answered_words(asked: DataFrame) -> DataFrame:
    """(chunk, n, size, keys, found, tokens, distinct) of the asked words: how often all texts that
    teach have each. One row of a bucket has its number of tokens and of distinct words."""

    def run(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_pylist()
        line = np.concatenate([unpack(x, np.uint8, n) for x, n in zip(group["words"].to_pylist(), group["size"].to_pylist())])
        starts, ends = line_spans(line)
        at = np.asarray(string_array(line, starts, ends - starts).dictionary_encode().indices)
        totals = np.bincount(at, np.concatenate([unpack(x, np.uint32, n) for x, n in zip(group["counts"].to_pylist(), sizes)])).astype(np.int64)
        found = [pack(totals[at[hi - n : hi]]) for hi, n in zip(np.cumsum(sizes), sizes)]
        sums = [pa.array([int(x)] + [0] * (len(found) - 1), pa.int64()) for x in (totals.sum(), (totals > 0).sum())]
        names = ["chunk", "n", "size", "keys", "found", "tokens", "distinct"]
        return pa.table([group["chunk"], group["n"], group["size"], group["words"], pa.array(found, pa.binary()), *sums], names)

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, n long, size long, keys binary, found binary, tokens long, distinct long")


ASKED = "near int, chunk long, n long, events binary, counts binary"


def asked_events(texts: DataFrame, kinds: int, across_words: bool) -> DataFrame:
    """(near, chunk, n, events, counts) of frozen texts: the n distinct events of a chunk whose two
    nearest bytes of context are `near`, and how often each kind of text has them."""

    def held_of(table, data, offsets):
        events, first = text_events(data, offsets, across_words)
        kind = np.asarray(table["kind"]).astype(np.uint64) << np.uint64(56)
        keys, times = np.unique(events | np.repeat(kind, np.diff(np.append(first, len(events)))), return_counts=True)
        return keys, times.astype(np.uint32)

    def merged(held):
        (first, sums), *more = held
        if not more:
            return first, sums
        keys, times = (np.concatenate(x) for x in zip(*more))
        order = np.argsort(keys)
        keys = keys[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, times = keys[cuts], np.add.reduceat(times[order], cuts, dtype=np.uint32)
        at = np.searchsorted(first, keys)
        there = first[np.minimum(at, len(first) - 1)] == keys
        sums[at[there]] += times[there]
        new = ~there
        return np.insert(first, at[new], keys[new]), np.insert(sums, at[new], times[new])

    def out(chunk, found):
        keys, times = found
        for nearest in range(256):
            parts = []
            for kind in [*range(kinds), NOTHING]:
                begin = (kind << 56) | (nearest << 48)
                lo, hi = np.searchsorted(keys, np.uint64(begin)), np.searchsorted(keys, np.uint64(begin | ((1 << 48) - 1)), "right")
                parts.append((keys[lo:hi] & np.uint64((1 << 56) - 1), times[lo:hi]))
            events = distinct(np.concatenate([x for x, _ in parts]))
            counts = np.zeros((kinds, len(events)), np.uint32)
            for kind in range(kinds):
                counts[kind, np.searchsorted(events, parts[kind][0])] = parts[kind][1]
            near = (events >> np.uint64(40)).astype(np.int64)
            if len(near):
                rows = [(int(near[lo]), chunk, int(hi - lo), pack(events[lo:hi]), pack(counts[:, lo:hi])) for lo, hi in slices_of(near)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

    schema = pa.schema({"near": pa.int32(), "chunk": pa.int64(), "n": pa.int64(), "events": pa.binary(), "counts": pa.binary()})
    return texts.mapInArrow(lambda batches: by_chunk(batches, held_of, merged, out), ASKED)


def group_counts(asked: pa.Table, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct events of a group, their counts by tree). The first tree is that of all texts, of
    whatever kind."""
    sizes = asked["n"].to_pylist()
    asks = [unpack(x, np.uint64, n) for x, n in zip(asked["events"].to_pylist(), sizes)]
    events = distinct(np.concatenate(asks))
    counts = np.zeros((kinds, len(events)))
    for ask, x in zip(asks, asked["counts"].to_pylist()):  # an event is in an ask once
        counts[:, np.searchsorted(events, ask)] += unpack(x, np.uint32, len(ask) * kinds).reshape(kinds, len(ask))
    counts[0] = counts.sum(axis=0)
    return events, counts


GROUPS = (
    "n long, events binary, counts binary, chunks array<long>, sizes array<long>, keys array<binary>, "
    "sums array<struct<place: long, zeros: double, ones: double, children: double>>"
)


def grouped_events(asked: DataFrame, kinds: int) -> DataFrame:
    """A row for each group: its n distinct events and their counts by tree, the asks (chunk, number
    and events of each), and what its contexts add to depths 0 and 1."""

    def run(group: pa.Table) -> pa.Table:
        events, counts = group_counts(group, kinds)
        kind, at = np.nonzero(counts)
        sums = below_top(events[at] | kind.astype(np.uint64) << np.uint64(56), counts[kind, at]) if len(at) else [np.zeros(0, np.int64)] + [np.zeros(0)] * 3
        sums = pa.StructArray.from_arrays([pa.array(x) for x in sums], ["place", "zeros", "ones", "children"])
        asks = [row_of(group[c].combine_chunks()) for c in ("chunk", "n", "events")]
        packed = [pa.array([x], pa.binary()) for x in (pack(events), pack(counts.astype(np.uint64)))]
        return pa.table([pa.array([len(events)]), *packed, *asks, row_of(sums)], ["n", "events", "counts", "chunks", "sizes", "keys", "sums"])

    return asked.groupBy("near").applyInArrow(run, GROUPS)


def row_of(values: pa.Array) -> pa.Array:
    """One row with all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def top_levels(groups: DataFrame, kinds: int) -> Top:
    """Depths 0 and 1, from sums over the groups: at most 65,536 rows a kind."""
    rows = groups.select(F.inline("sums"))
    sums = rows.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).orderBy("place").toArrow()
    return Top(*(np.asarray(sums[c]) for c in ("place", "zeros", "ones", "children")), kinds)


def answered_events(groups: DataFrame, kinds: int) -> DataFrame:
    """(chunk, n, size, keys, found) of the asked events: the log10 probability of each in each tree.
    `size` is null. Groups are whole rows, so nothing is shuffled to answer."""
    top = groups.sparkSession.sparkContext.broadcast(top_levels(groups, kinds))

    def answers(n, events, counts, chunks, sizes, keys):
        events, counts = unpack(events, np.uint64, n), unpack(counts, np.uint64, n * kinds).reshape(kinds, n)
        logs, some = np.zeros((kinds, n), np.float32), max(1, GROUP_EVENTS // n)
        marks = np.arange(kinds, dtype=np.uint64)[:, None] << np.uint64(56)
        for k in range(0, kinds, some):  # the trees of a small group are worked on together
            mine, wanted = counts[k : k + some], events | marks[k : k + some]
            levels = group_levels(wanted[mine > 0], mine[mine > 0].astype(float))
            found, wanted = logs[k : k + some].reshape(-1), wanted.ravel()
            for lo in range(0, len(wanted), 1 << 16):
                found[lo : lo + (1 << 16)] = event_logs(wanted[lo : lo + (1 << 16)], levels, top.value)
        for chunk, size, ask in zip(chunks, sizes, keys):
            found = pack(logs[:, np.searchsorted(events, unpack(ask, np.uint64, size))])
            yield {"chunk": chunk, "n": size, "size": None, "keys": ask, "found": found}

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(len(batch)):
                for row in answers(*(batch.column(c)[k].as_py() for c in ("n", "events", "counts", "chunks", "sizes", "keys"))):
                    held.append(row)
                    size += len(row["found"]) + len(row["keys"])
                    if size > ANSWER_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema({"chunk": pa.int64(), "n": pa.int64(), "size": pa.int64(), "keys": pa.binary(), "found": pa.binary()})
    wanted = groups.select("n", "events", "counts", "chunks", "sizes", "keys")
    return wanted.mapInArrow(run, "chunk long, n long, size long, keys binary, found binary")


class Answers:
    """What a chunk was answered; packed, and not copied, until the first read."""

    def __init__(self, kinds: int):
        self.kinds, self.words, self.events, self.known = kinds, [], [], None

    def add(self, n: int, size: int | None, keys: pa.Buffer, found: pa.Buffer) -> None:
        if size is None:
            self.events.append((n, keys, found))
        else:
            self.words.append((n, size, keys, found))

    def read(self) -> tuple[Places, np.ndarray, Places, np.ndarray]:
        """(hashes of words, how often each is in texts that teach, events, log10 probabilities of
        each by tree). A chunk that two tasks read has asked twice, and has equal answers."""
        if self.known is None:
            line = np.concatenate([np.zeros(0, np.uint8), *[unpack(keys, np.uint8, size) for _, size, keys, _ in self.words]])
            totals = np.concatenate([np.zeros(0), *[unpack(found, np.int64, n) for n, _, _, found in self.words]])
            words, self.words = Places(span_hash(line, *line_spans(line))), []
            size, done = sum(n for n, _, _ in self.events), 0
            events, logs = np.empty(size, np.uint64), np.empty((size, self.kinds), np.float32)
            while self.events:
                n, keys, found = self.events.pop()
                events[done : done + n] = unpack(keys, np.uint64, n)
                logs[done : done + n] = unpack(found, np.float32, n * self.kinds).reshape(self.kinds, n).T
                done += n
            self.known = words, totals, Places(events), logs
        return self.known


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def score(docs: DataFrame, is_training: Column, kind: Column | None = None, across_words: bool = False) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each
    row of `docs` (doc_id, text), by the model of the rows that `is_training` picks. `kind` is only
    read on training rows; where it is null, they teach the common tree alone. `across_words`:
    contexts run on over the beginnings of words, to the text's."""
    kind = F.lit(None).cast("string") if kind is None else kind.cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(is_training, F.lit(False)).alias("training"), kind.alias("named"))
    training = docs.filter("training")
    common = training.filter("named is not null").groupBy("named").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "named").limit(KINDS).collect()
    numbers = F.create_map(*[x for k, r in enumerate(common) for x in (F.lit(r["named"]), F.lit(k + 1))]) if common else None
    number = F.coalesce(numbers[F.col("named")], F.lit(0)) if common else F.lit(0)
    kinds = len(common) + 1
    priors = [1.0, *[float(r["n"]) for r in common]]
    priors = [math.log10(p / sum(priors)) for p in priors]
    teaches = F.when(F.col("training"), number).otherwise(NOTHING).cast("int").alias("kind")
    texts, chunks = in_chunks(docs.select("doc_id", "training", teaches, "text"))
    with small_batches(docs.sparkSession):
        words = stored(answered_words(asked_words(texts, chunks)), "words")
    size = words.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    ends = training.count()  # each text has one end, which is a word of its own
    tokens, distinct = (size["tokens"] or 0) + ends, (size["distinct"] or 0) + (1 if ends else 0)
    whole = tokens + 0.1 * (distinct + 1)
    end_base = math.log10((ends + 0.1) / whole)
    with small_batches(docs.sparkSession):
        groups = stored(grouped_events(asked_events(texts, kinds, across_words), kinds), "groups")
    answers = answered_events(groups, kinds).unionByName(words.select("chunk", "n", "size", "keys", "found"))
    rows = texts.select("chunk", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("size"), F.col("rows").alias("keys"), F.lit(None).cast("binary").alias("found"))

    def summed(batches):
        at, held = None, None
        for batch in batches:
            for chunk, n, size, keys, found in zip(*batch.columns):
                if chunk.as_py() != at:  # its answers come first, then its texts
                    at, held = chunk.as_py(), None
                    pa.default_memory_pool().release_unused()
                    held = Answers(kinds)
                if found.is_valid:
                    held.add(n.as_py(), size.as_py(), keys.as_buffer(), found.as_buffer())
                else:
                    yield of_texts(keys.as_buffer(), *held.read())

    def of_texts(frozen_rows, words: Places, totals: np.ndarray, places: Places, logs: np.ndarray) -> pa.RecordBatch:
        table, data, offsets = thawed(frozen_rows)
        starts, stops, bounds = word_spans(data, offsets)
        row, n = np.repeat(np.arange(len(table)), np.diff(bounds)), len(table)
        found = totals[words.find(span_hash(data, starts, stops))] if len(starts) else np.zeros(0)
        wanted, first = text_events(data, offsets, across_words)
        sums = np.add.reduceat(logs[places.find(wanted)], first, dtype=float)
        own = [np.diff(bounds) + 1, np.diff(offsets), np.bincount(row, found > 0, n).astype(np.int64) + (1 if ends else 0)]
        own.append(np.bincount(row, np.log10((found + 0.1) / whole), n) + end_base)
        plain = [table[c].combine_chunks() for c in ("doc_id", "training")]
        return pa.RecordBatch.from_arrays([*plain, *map(pa.array, own), lists(sums)], names)

    names = ["doc_id", "training", "n_tokens", "n_bytes", "n_known", "base_score", "logp"]
    schema = "doc_id long, training boolean, n_tokens long, n_bytes long, n_known long, base_score double, logp array<double>"
    together = answers.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.col("found").isNull())
    with small_batches(docs.sparkSession):
        rows = stored(together.mapInArrow(summed, schema), "sums")
    by_tree = [F.get("logp", F.lit(k)) + priors[k] for k in range(kinds)]
    top = F.greatest(*by_tree) if kinds > 1 else by_tree[0]
    mixture = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in by_tree[1:]), F.pow(F.lit(10.0), by_tree[0] - top)))
    return rows.withColumn("score", mixture).select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / math.log10(2) / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"),
    )
