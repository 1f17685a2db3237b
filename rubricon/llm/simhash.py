"""SimHash near-duplicates, linked exactly by sharded vantage-point trees.

Equal fingerprints are folded first. The distinct ones start in one shard; every shard that is
too large is split at vantage points taken from itself: a level of the tree sends a fingerprint
inwards or outwards by its Hamming distance to the level's point. By the triangle inequality a
linked pair can only be parted where the inner one lies within the link radius of the boundary,
so inner fingerprints of that rim go to both sides: every linked pair meets in some shard.
Within a shard the tree goes on down to small leaves in the same way; only the pairs of a leaf are
compared. A shard gives at most one link for every fingerprint in it.

Texts without words (nulls, empty, white space) have fingerprint zero and are linked like others.
Rows with a null doc_id get the component of their fingerprint, but never name one. Repeated rows
are kept. Other columns are dropped by `near_duplicates`, kept by `fingerprints`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.bpe import with_column
from rubricon.llm.components import components
from rubricon.llm.flat import gather_spans, lower_ascii, row_rounds, text_bytes, word_spans
from rubricon.session import stored

SHINGLE, SEED, RADIUS = 3, 42, 2
#: A shard above the limit is split into parts of about the target.
SHARD_LIMIT, SHARD_TARGET = 1 << 15, 1 << 13
#: Fingerprints of a shard from which vantage points and radii are taken; they only set the balance.
SAMPLE = 512
LEVELS_AT_ONCE = 8
#: Within a shard the tree goes on down to leaves of this size, with a smaller choice of points.
LEAF, LEAF_SAMPLE, LEAF_VANTAGES = 512, 256, 4


def text_fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of flat texts."""
    data = lower_ascii(data)
    starts, ends, words = word_spans(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    # The words joined by single spaces, so that a shingle is one span.
    joined = np.concatenate([data, [np.uint8(0x20)]])
    lengths = ends - starts
    index = gather_spans(starts, lengths + 1)
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    joined = joined[index]
    joined[begin + lengths] = 0x20
    raw, end = joined.tobytes(), begin + lengths
    per_row = np.diff(words)
    shingles = np.where(per_row == 0, 0, np.maximum(per_row - SHINGLE + 1, 1))
    first = gather_spans(words[:-1], shingles)
    last = np.minimum(first + SHINGLE - 1, np.repeat(words[1:] - 1, shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist())), np.uint64, len(first)
    )
    full = np.flatnonzero(shingles)
    cuts = np.cumsum(shingles) - shingles
    for lo, hi in row_rounds(np.append(cuts[full], len(hashes)), 1 << 16):
        rows = full[lo:hi]
        a, b = cuts[rows[0]], cuts[rows[-1]] + shingles[rows[-1]]
        if len(rows) == 1:
            ones = sum(
                np.unpackbits(hashes[c : min(c + (1 << 16), b)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                for c in range(a, b, 1 << 16)
            )[None]
        else:
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, cuts[rows] - a, axis=0, dtype=np.int64)
        set_ = (2 * ones > shingles[rows][:, None]).astype(np.uint8)
        out[rows] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long (the 64 bits as a signed number)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for lo, hi in row_rounds(offsets):
                made = text_fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield with_column(batch.slice(lo, hi - lo), out, pa.array(made.view(np.int64)))

    return df.mapInArrow(run, df.drop(out).withColumn(out, F.lit(0).cast("long")).schema)


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int64)


def vantage_levels(sample: np.ndarray, levels: int, tried: int = 24) -> list[tuple[int, int]]:
    """(vantage point, inner radius) for each level: of a few candidates the one whose rim, which
    both sides get, is smallest beside what the split takes off the larger side."""
    chosen, points = [], list(sample[:: max(1, len(sample) // tried)][:tried])
    for _ in range(levels):
        best = None
        for point in points:
            d = np.sort(distances(sample, point))
            for radius in {int(d[len(d) * part // 8]) for part in (3, 4, 5)}:
                inner, rim = (d <= radius).mean(), ((d <= radius) & (d > radius - RADIUS)).mean()
                cost = max(inner, 1 - inner + rim) + rim / 2
                if best is None or cost < best[0]:
                    best = (cost, int(point), radius)
        chosen.append(best[1:])
        points = [p for p in points if int(p) != best[1]] or points
    return chosen


def sent_to(points: np.ndarray, levels: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, its part) for every part that a point belongs to."""
    index, part = np.arange(len(points)), np.zeros(len(points), np.int64)
    for point, radius in levels:
        d = distances(points[index], np.uint64(point))
        outer, rim = d > radius, (d <= radius) & (d > radius - RADIUS)
        index = np.concatenate([index, index[rim]])
        part = np.concatenate([part << 1 | outer, part[rim] << 1 | 1])
    return index, part


def sharded(points: DataFrame) -> DataFrame:
    """`points` (fp, rep) with a `shard`, so that every pair within the radius shares one. Splitting ends
    when no shard is above the limit, or when a round no longer makes the largest one smaller."""
    rows = stored(points.withColumn("shard", F.lit(0).cast("long")), "shards")
    largest = None
    while True:
        sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_LIMIT).collect()}
        if not sizes or (largest and max(sizes.values()) > 0.9 * largest):
            break
        largest = max(sizes.values())
        rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(SAMPLE / n))])
        large = rows.filter(F.col("shard").isin(list(sizes)))
        taken = large.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < rate[F.col("shard")] * (1 << 20))
        sample: dict[int, list[int]] = {}
        for r in taken.select("shard", "fp").collect():
            sample.setdefault(r["shard"], []).append(r["fp"])
        plan = {}
        for shard, fps in sample.items():
            levels = min(LEVELS_AT_ONCE, max(1, math.ceil(math.log2(sizes[shard] / SHARD_TARGET))))
            plan[shard] = vantage_levels(np.sort(np.array(fps, np.int64)).view(np.uint64), levels)

        def split(batches, plan=plan):
            for batch in batches:
                fps = np.asarray(batch.column(0)).view(np.uint64)
                shards = np.asarray(batch.column(2))
                rows_at, into = [np.flatnonzero(~np.isin(shards, list(plan)))], []
                into.append(shards[rows_at[0]])
                for shard, levels in plan.items():
                    own = np.flatnonzero(shards == shard)
                    index, part = sent_to(fps[own], levels)
                    rows_at.append(own[index])
                    salt = np.uint64((shard * 31 + len(levels)) % (1 << 64))
                    into.append((((part + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt).view(np.int64))
                at = pa.array(np.concatenate(rows_at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(into))], ["fp", "rep", "shard"])

        rows = stored(rows.mapInArrow(split, "fp long, rep long, shard long"), "shards")
    return rows


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's root, the smallest of its set) after the links a-b."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(la[differ], lb[differ]), np.minimum(la[differ], lb[differ]))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def leaves(fps: np.ndarray):
    """Places of the fingerprints of each leaf of a vantage-point tree over a shard. A node's rim goes
    to both branches, as between shards, so that every pair within the radius shares a leaf and all
    other branches are pruned. What no vantage point splits well is a leaf of any size."""
    open_nodes = [np.arange(len(fps))]
    while open_nodes:
        at = open_nodes.pop()
        if len(at) > LEAF:
            own = fps[at]
            point, radius = vantage_levels(np.sort(own[:: max(1, len(own) // LEAF_SAMPLE)]), 1, tried=LEAF_VANTAGES)[0]
            d = distances(own, np.uint64(point))
            inner, outer = at[d <= radius], at[d > radius - RADIUS]
            if max(len(inner), len(outer)) <= 0.9 * len(at):
                open_nodes += [inner, outer]
                continue
        yield at


def shard_links(table: pa.Table) -> pa.Table:
    """At most one link for each fingerprint of a shard, with the shard's components. Pairs are
    compared within the leaves of its tree, in blocks."""
    fps, reps = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["rep"])
    labels = np.arange(len(fps))
    for at in leaves(fps):
        own = fps[at]
        for lo in range(0, len(at), 256):
            a, b = np.nonzero(np.bitwise_count(own[lo : lo + 256, None] ^ own[lo:]) <= RADIUS)
            apart = a < b
            if apart.any():
                labels = unite(labels, at[a[apart] + lo], at[b[apart] + lo])
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return pa.table({"u": pa.array(reps[linked]), "v": pa.array(reps[labels[linked]])})


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id that links reach."""
    marked = fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "fp")
    docs = stored(marked.select("doc_id", "fp"), "fingerprints")
    classes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    named = classes.filter(F.col("rep").isNotNull()).select("fp", "rep")
    links = sharded(named).groupBy("shard").applyInArrow(shard_links, "u long, v long")
    roots = components(links)
    owners = classes.join(roots, classes.rep == roots.id, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return docs.join(owners, "fp").select("doc_id", "fp", "component_id")
