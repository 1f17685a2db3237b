"""Groups of spelling variants, by search schemes on bidirectional FM-indexes of the vocabulary.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut the shorter
word (either, if equally long) in half: the difference lies in one half, so the other one stands
unchanged at the same end of both words. One scheme matches the first half exactly and extends to
the right across the second one, allowing one error; the other is its mirror image. Both walk
suffix-rank intervals of an index over the vocabulary with delimiters: each interval stands for
all words that begin (or end) with what has been matched, and its last step is a delimiter, so
only whole words are found.

Spark shards the vocabulary by halves: a word is indexed under the halves of its own length and
of the length one less, and asks under those of its own. Every near pair meets in a shard of the
half that both share, so no shard needs the others. Shards are hashes of halves; their number
comes from the size of the vocabulary, about `SHARD_WORDS` entries each. A half with more words
than that is split: its words are indexed in parts, and those that ask are sent to every part.
Links are reduced to a count and the best near word before they are shuffled.

A null text has no words, a null document id is the empty text in the hash. Repeated rows count
as often as they occur. Only the returned columns exist, so others can't clash. An empty table
and one without frequent words give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.flat import gather_spans, lower_ascii, row_rounds, text_bytes
from rubricon.session import stored

#: Entries of a shard; a half with more words is split into parts of that size.
SHARD_WORDS = 1 << 16
#: Counts that a task holds before it hands them on.
HELD_WORDS = 1 << 18
#: Words that are searched at a time.
ROUND_WORDS = 1 << 13
BLOCK = 64


def crc_table() -> np.ndarray:
    """The byte table of the CRC-32 with the reversed polynomial EDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def crc_on(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of byte spans, each put behind what its state was taken of."""
    out = ~states
    long = np.flatnonzero(ends - starts > 256)
    live, at = np.flatnonzero((ends > starts) & (ends - starts <= 256)), 0
    while len(live):
        s = out[live]
        out[live] = CRC[(s ^ data[starts[live] + at]) & 255] ^ (s >> 8)
        at += 1
        live = live[ends[live] - starts[live] > at]
    out = ~out
    for k in long:
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(states[k]))
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of A-Z, a-z and U+00C0-U+00FF, which all have the lead byte C3."""
    inside = ((data | 32) - np.uint8(97) < 26) & (data < 128)
    wide = np.flatnonzero(data == 0xC3)
    inside[wide] = inside[wide + 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    return starts, ends


def round_words(data: np.ndarray, offsets: np.ndarray, ids: list[str], least: int, modulus: int) -> pa.Array:
    """The words of a round of texts: their runs, of some of which a code point is deleted."""
    data = lower_ascii(data)
    starts, ends = letter_runs(data, offsets)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = heads[ends] - heads[starts] >= least
    starts, ends = starts[keep], ends[keep]
    length = heads[ends] - heads[starts]
    states = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crc_on(states[np.searchsorted(offsets, starts, "right") - 1], data, starts, ends).astype(np.int64)
    hit = np.flatnonzero(h % modulus == 0)
    gone = np.zeros(len(data), bool)
    place = np.flatnonzero((data & 0xC0) != 0x80)[heads[starts[hit]] + h[hit] % length[hit]]
    gone[place] = True
    gone[place[data[place] == 0xC3] + 1] = True
    length[hit] -= 1
    keep = length >= least
    at = gather_spans(starts[keep], (ends - starts)[keep])
    stays = ~gone[at]
    left = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum((ends - starts)[keep])])]
    return pa.LargeStringArray.from_buffers(int(keep.sum()), pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[at[stays]].tobytes()))


def word_counts(df: DataFrame, text: str, doc_id: str, least: int, modulus: int) -> DataFrame:
    """(word, n) of all texts; tasks add up before they shuffle."""

    def run(batches):
        held, size = [], 0

        def summed():
            one = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": one["word"], "n": one["n_sum"]})

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for lo, hi in row_rounds(offsets):
                begin, end = offsets[lo], offsets[hi]
                if begin == end:
                    continue
                words = round_words(data[begin:end], offsets[lo : hi + 1] - begin, ids[lo:hi], least, modulus)
                counts = pc.value_counts(words)
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                size += len(counts)
                if size > HELD_WORDS:
                    held = [summed()]
                    size = len(held[0])
                    if size > HELD_WORDS // 2:
                        yield from held[0].cast(schema).to_batches()
                        held, size = [], 0
        if held:
            yield from summed().cast(schema).to_batches()

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words as dense symbols, from 1 on, in one flat array; 0 is the delimiter."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.alphabet, flat = np.unique(codes, return_inverse=True)
        self.flat = (flat + 1).astype(np.int64)

    def backwards(self) -> np.ndarray:
        """The same words, each read from its end."""
        at = np.repeat(2 * self.starts + self.lengths - 1, self.lengths) - np.arange(len(self.flat))
        return self.flat[at]


class Index:
    """The FM-index of delimited words: suffix ranks, the symbols before them, counts at blocks."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, symbols: int):
        words, n = len(lengths), len(flat) + len(lengths)
        text, self.word = np.zeros(n, np.int64), np.repeat(np.arange(words), lengths + 1)
        at = np.arange(len(flat)) + np.repeat(np.arange(words), lengths)
        text[at] = flat
        self.suffixes = self._sorted(text, at, words)
        before = text[self.suffixes - 1].astype(np.uint8)
        self.size = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.before = np.concatenate([before, np.full(-n % BLOCK + BLOCK, 255, np.uint8)])
        self.blocks = self.before.reshape(-1, BLOCK)
        places = np.arange(n) // BLOCK * (symbols + 1) + before
        counts = np.bincount(places, minlength=len(self.blocks) * (symbols + 1)).reshape(-1, symbols + 1)
        at_block = np.cumsum(counts, 0) - counts
        self.below = np.zeros((len(self.blocks), symbols + 2), np.int32)
        np.cumsum(at_block, 1, out=self.below[:, 1:])
        self.ends = np.flatnonzero(before == 0)

    @staticmethod
    def _sorted(text: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
        """Suffixes in order, by doubling; the delimiters differ, in the order of their words."""
        n = len(text)
        rank = text + words
        ends = np.ones(n, bool)
        ends[at] = False
        rank[ends] = np.arange(words)
        width = 1
        while True:
            key = rank * (2 * n + 2)
            if width < n:
                key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if n == 0 or fresh[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            width *= 2

    def _counted(self, hits: np.ndarray, off: np.ndarray) -> np.ndarray:
        bits = np.packbits(hits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return np.bitwise_count(bits & ((np.uint64(1) << off.astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol precedes the suffixes of rank less than `at`."""
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 1 << 16):
            c, i = symbol[k : k + (1 << 16)], at[k : k + (1 << 16)]
            b = i // BLOCK
            base = self.below[b, c + 1] - self.below[b, c]
            out[k : k + (1 << 16)] = base + self._counted(self.blocks[b] == c[:, None], i % BLOCK)
        return out

    def smaller(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many suffixes of rank less than `at` a smaller symbol precedes."""
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 1 << 16):
            c, i = symbol[k : k + (1 << 16)], at[k : k + (1 << 16)]
            b = i // BLOCK
            out[k : k + (1 << 16)] = self.below[b, c] + self._counted(self.blocks[b] < c[:, None], i % BLOCK)
        return out

    def extend(self, lo: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, size) of the interval with a symbol put before what it stands for."""
        below = self.occurrences(symbol, lo)
        return self.first[symbol] + below, self.occurrences(symbol, lo + size) - below


def anchored(exact: Index, other: Index, flat, starts, half) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in `other` of all words that begin with these halves.

    The half is matched in `exact` from its end to its beginning and then to the delimiter, which
    also moves the interval of `other`: by the number of smaller symbols before the suffixes."""
    lo, there = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    size = np.full(len(starts), exact.size, np.int64)
    for step in range(int(half.max(initial=0)) + 1):
        live = np.flatnonzero((half >= step) & (size > 0))
        place = half[live] - 1 - step
        symbol = np.where(place < 0, 0, flat[starts[live] + np.maximum(place, 0)])
        there[live] += exact.smaller(symbol, lo[live] + size[live]) - exact.smaller(symbol, lo[live])
        lo[live], size[live] = exact.extend(lo[live], size[live], symbol)
    return there, size


def one_error(exact: Index, other: Index, flat, starts, lengths, half, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking word, word found, whether that is longer): the first `half` symbols are equal, behind
    them one symbol is replaced or inserted; each such word once."""
    if not len(asks):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    begin, ends, half = starts[asks], lengths[asks], half[asks]
    lo, size = anchored(exact, other, flat, begin, half)
    found = []
    for place in range(int(half.min()), int(ends.max()) + 1):
        live = np.flatnonzero((half <= place) & (place <= ends) & (size > 0))
        if not len(live):
            continue
        own = np.where(place < ends[live], flat[np.minimum(begin[live] + place, len(flat) - 1)], -1)
        for q, child, longer in branches(other, lo[live], size[live], own):
            q, at = live[q], np.where(longer, place, place + 1)
            found.append(finish(other, flat, begin, ends, q, at, *child, longer))
        goes = own >= 0
        live, own = live[goes], own[goes]
        lo[live], size[live] = other.extend(lo[live], size[live], own)
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    q, words, longer = (np.concatenate(x) for x in zip(*found))
    return asks[q], words, longer


def branches(index: Index, lo: np.ndarray, size: np.ndarray, own: np.ndarray):
    """Rounds of (query, (lo, size), inserted) for every symbol but the query's own (-1: none) that
    can follow. Intervals of equally long texts are equal or disjoint, so each is read once."""
    nodes, which = np.unique(lo, return_inverse=True)
    spans = np.zeros(len(nodes), np.int64)
    spans[which] = size
    node = np.repeat(np.arange(len(nodes)), spans)
    kinds = len(index.first) - 1
    follows = np.bincount(node * kinds + index.before[gather_spans(nodes, spans)], minlength=len(nodes) * kinds).reshape(-1, kinds)
    follows[:, 0] = 0
    at, symbol = np.nonzero(follows)
    child_size, child_lo = follows[at, symbol], index.first[symbol] + index.occurrences(symbol, nodes[at])
    first = np.searchsorted(at, np.arange(len(nodes) + 1))
    for k in range(0, len(lo), ROUND_WORDS):
        w = which[k : k + ROUND_WORDS]
        many = first[w + 1] - first[w]
        pick = gather_spans(first[w], many)
        q = np.repeat(np.arange(k, k + len(w)), many)
        other = symbol[pick] != own[q]
        q, pick = q[other], pick[other]
        child = child_lo[pick], child_size[pick]
        yield q, child, np.ones(len(q), bool)
        here = own[q] >= 0
        yield q[here], (child[0][here], child[1][here]), np.zeros(int(here.sum()), bool)


def finish(index: Index, flat, begin, ends, q, at, lo, size, longer):
    """Matches the rest of each word exactly and then the delimiter: (query, word found, inserted)."""
    done = []
    while len(q):
        over = at == ends[q]
        if over.any():
            none = np.zeros(int(over.sum()), np.int64)
            below = index.occurrences(none, lo[over])
            whole = index.occurrences(none, lo[over] + size[over]) > below
            words = index.word[index.suffixes[index.ends[below[whole]]]]
            done.append((q[over][whole], words, longer[over][whole]))
            q, at, lo, size, longer = (x[~over] for x in (q, at, lo, size, longer))
        lo, size = index.extend(lo, size, flat[begin[q] + at])
        live = size > 0
        q, at, lo, size, longer = q[live], at[live] + 1, lo[live], size[live], longer[live]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*done))


def shard_links(table: pa.Table) -> pa.Table:
    """Of a shard's entries (side, word, n, indexed, asks): the links (word, near, near_n) that its scheme finds."""
    right = table["side"][0].as_py() == "first"
    table = table.group_by("word").aggregate([("n", "max"), ("indexed", "max"), ("asks", "max")])
    texts, n = table["word"].to_pylist(), table["n_max"].to_numpy()
    indexed, asks = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("indexed_max", "asks_max"))
    every = Vocabulary(texts)
    backwards, symbols = every.backwards(), len(every.alphabet)
    lengths = every.lengths[indexed]
    at, starts = gather_spans(every.starts[indexed], lengths), np.cumsum(lengths) - lengths
    plain, mirror = (Index(flat[at], starts, lengths, symbols) for flat in (every.flat, backwards))
    if right:
        a, b, longer = one_error(plain, mirror, every.flat, every.starts, every.lengths, every.lengths // 2, asks)
    else:
        a, b, longer = one_error(mirror, plain, backwards, every.starts, every.lengths, (every.lengths + 1) // 2, asks)
    b = indexed[b]
    if not right:  # what has the first half in common as well is found on the other side
        fresh = np.fromiter((texts[x][: len(texts[x]) // 2] != texts[y][: len(texts[x]) // 2] for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
        a, b, longer = a[fresh], b[fresh], longer[fresh]
    words = pa.array(texts, pa.string())
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    return pa.table({"word": words.take(pa.array(a)), "near": words.take(pa.array(b)), "near_n": pa.array(n[b], pa.int64())})


def entries(words: DataFrame, total: int) -> DataFrame:
    """(side, shard, word, n, indexed, asks): every word under its halves, see the module's text."""
    size = F.char_length("word")
    half = lambda side, length: F.expr(f"{'left' if side == 'first' else 'right'}(word, cast({length} as int))")
    # Of its own length, where the word also asks, and of the length one less, if that is another half.
    halves = [
        ("first", half("first", "char_length(word) div 2"), True, F.lit(True)),
        ("first", half("first", "(char_length(word) - 1) div 2"), False, size % 2 == 0),
        ("last", half("last", "(char_length(word) + 1) div 2"), True, F.lit(True)),
        ("last", half("last", "char_length(word) div 2"), False, size % 2 == 1),
    ]
    placed = [F.struct(F.lit(s).alias("side"), h.alias("half"), F.lit(asks).alias("asks"), kept.alias("kept")) for s, h, asks, kept in halves]
    rows = words.select("word", "n", F.inline(F.filter(F.array(*placed), lambda x: x["kept"]))).drop("kept")
    hot = rows.groupBy("side", "half").count().filter(F.col("count") > SHARD_WORDS)
    hot = hot.select("side", "half", F.ceil(F.col("count") / SHARD_WORDS).cast("int").alias("parts"))
    shards = max(1, -(-4 * total // SHARD_WORDS))
    place = F.pmod(F.xxhash64("word"), "parts")
    # At most 4 * total / SHARD_WORDS halves are hot.
    dealt = rows.join(F.broadcast(hot), ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(place.cast("int")))))
    return dealt.select(
        "side",
        F.when(F.col("parts") > 1, F.xxhash64("side", "half", "part")).otherwise(F.pmod(F.xxhash64("half"), F.lit(shards))).alias("shard"),
        "word", "n", (F.col("part") == place).alias("indexed"), "asks",
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of every word (word, n) that has near words: their number and the
    one with the largest n (ties: the smallest in code-point order)."""
    links = entries(words, words.count()).groupBy("side", "shard").applyInArrow(shard_links, "word string, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return links.groupBy("word").agg(F.count("*").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): forms are followed to the last. A form is several
    times as frequent as its word, so there are few rounds."""
    ahead = forms.select(F.col("word").alias("root"), F.col("form").alias("further"))
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        step = stored(found.join(ahead, "root", "left"), "roots")
        found = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.filter("further is not null").isEmpty():
            return found


def variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 7, least_count: int = 2, ratio: int = 10, modulus: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least `least_length` code points and
    `least_count` occurrences. Of every `modulus`-th run (by a hash of document and run) a code point
    is left out first. `form`: the most frequent near word, if at least `ratio` times as frequent."""
    counts = word_counts(df, text, doc_id, least_length, modulus).filter(F.col("n") >= least_count)
    words = stored(counts, "words")
    near = near_words(words)
    formed = F.col("near_n") >= ratio * F.col("n")
    joined = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(joined.filter("form is not null").select("word", "form"))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
