"""Nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random orthogonal directions; every curve shifts and permutes them
anew and gives each vector its Hilbert key. Spark range-partitions the rows of each curve by key,
and a query is compared with its neighbouring key window on every curve; the answers of all curves
merge and are reranked. They are the result, but for what a check adds: their k-th distance bounds
the true one from above, and each short key window of the first curve has a centre and a radius. A
window that the triangle inequality can't rule out is open for a query, and only its rows are
compared with that query. So answers are exact, however badly keys keep neighbours together; on
clustered data few windows are open, on random directions nearly all.

The check moves no rows: slices of the queries, bounded in bytes, go to the rows of the first curve
where these lie, and a task gives out the k best of its rows for each query at most.

Vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part. Of rows with the same vec_id one counts, the smallest vector. Equal
distances go to the smaller vec_id. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.text import int_div
from rubricon.session import stored

#: Directions kept by the projection and bits of each in a key.
DIRECTIONS, BITS = 8, 7
#: Rows on either side of a query in key order that its curve window takes.
REACH = 200
#: Rows of a key window with centre and radius.
WINDOW_ROWS = 256
#: Bytes of the vectors (as doubles) of a slice of queries, which every task holds; queries at once.
SLICE_BYTES, QUERY_ROWS = 32 << 20, 4096
#: Candidates that a task gathers before it keeps the best of each query only.
HELD_CANDIDATES = 1 << 20

FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows, dimensions) with `bits` bits each."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_frames(dimension: int, curves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of each curve, the same in every task."""
    frames = []
    for curve in range(curves):
        draw = np.random.default_rng(1000 + curve)
        turned = np.linalg.qr(draw.normal(size=(dimension, dimension)))[0][:, :DIRECTIONS]
        frames.append((turned, draw.uniform(0, 1, turned.shape[1])))
    return frames


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query index, row index, distance) of each query's k nearest rows but its own."""
    rough = (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * queries @ rows.T
    rough[query_ids[:, None] == ids] = np.inf
    if rough.shape[1] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(queries), np.inf)
    scale = (queries**2).sum(1) + (rows**2).sum(1).max(initial=0)
    q, r = np.nonzero((rough <= (limit + 1e-9 * scale)[:, None]) & np.isfinite(rough))
    exact = np.empty(len(q))
    for lo in range(0, len(q), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        exact[part] = np.sqrt(((queries[q[part]] - rows[r[part]]) ** 2).sum(1))
    order = np.lexsort((ids[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], exact[keep]


def answers(query_ids, ids, found) -> pa.RecordBatch:
    q, r, distance = found
    columns = [pa.array(query_ids[q], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(distance)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])


def packed(v: np.ndarray, kind: str) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(v, kind)
    offsets = np.arange(len(v) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """The matrix that `packed` was given, as doubles."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    flat = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]).view(kind)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part. Only vectors whose id comes again are shuffled."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "float" if df.select(F.col(vector)).dtypes[0][1] == "array<float>" else "double"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = rows.filter(v.isNotNull() & F.col("vec_id").isNotNull()).filter(fine & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (common["n"] if common else 0))
    again = stored(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    once = rows.join(again, "vec_id", "left_anti")
    return once.unionByName(rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def open_pairs(queries: np.ndarray, bound: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(queries, windows): may the window hold a row within the query's bound?"""
    scale = (queries**2).sum(1)[:, None] + (centres**2).sum(1)
    square = scale - 2 * queries @ centres.T
    with np.errstate(invalid="ignore"):
        return ~(np.sqrt(np.maximum(square - 1e-9 * scale, 0)) - radius > bound[:, None] * (1 + 1e-9))


class Nearest:
    """The k best rows of a slice of queries among the windows shown so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        #: Distance that a row may have at most: what the curves found, then what the task has found.
        self.limit = bound.copy()
        # Rough distances are made near the queries' mean, in single precision; those that may be
        # within the limit are then worked out exactly.
        self.mean = vectors.mean(0)
        near = vectors - self.mean
        self.square = (near**2).sum(1)
        self.near = np.column_stack([-2 * near, np.ones(len(near)), np.zeros(len(near))]).astype(np.float32)
        self.slack = 4e-7 * (vectors.shape[1] + 8)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def show(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Compare a window with the queries it is open for."""
        centre = rows.mean(0)
        radius = np.sqrt(((rows - centre) ** 2).sum(1)).max()
        at = np.flatnonzero(open_pairs(self.v, self.limit, centre[None], radius[None])[:, 0])
        near = rows - self.mean
        square = (near**2).sum(1)
        with np.errstate(over="ignore"):
            wide = np.column_stack([near, square, np.ones(len(rows))]).astype(np.float32).T.copy()
        for lo in range(0, len(at), QUERY_ROWS):
            part = at[lo : lo + QUERY_ROWS]
            # (distance squared) - (limit squared) - slack, out of one product.
            asked = self.near[part]
            limit = self.limit[part] ** 2
            asked[:, -1] = self.square[part] - limit - self.slack * (self.square[part] + square.max() + np.where(np.isinf(limit), 0, limit))
            with np.errstate(over="ignore", invalid="ignore"):
                rough = asked @ wide
            for q, r in self._within(part, rough, ids, rows):
                self.found.append((q, ids[r[0]], r[1]))
                self.held += len(q)
            if self.held > HELD_CANDIDATES:
                self.settle()

    def _within(self, part: np.ndarray, rough: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        q, r = np.nonzero(~(rough > 0))  # what overflowed is worked out, too
        for lo in range(0, len(q), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            asked, row = part[q[cut]], r[cut]
            exact = np.sqrt(((self.v[asked] - rows[row]) ** 2).sum(1))
            good = (exact <= self.limit[asked]) & (self.ids[asked] != ids[row])
            if good.any():
                yield asked[good], (row[good], exact[good])

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row id, distance) of the best so far; the limits are drawn to them."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        q, ids, exact = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, exact, q))
        q, ids, exact = q[order], ids[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], exact[last])
        keep = place < self.k
        self.found = [(q[keep], ids[keep], exact[keep])]
        self.held = 0
        return self.found[0]


def best(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search(
    df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", curves: int = 4
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all rows for each row that `is_query`
    (over `vec_id`) picks."""
    rows = usable(df, vec_id, vector)
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"

    def on_curve(chosen: list[int]) -> DataFrame:
        """The rows of these curves in key order."""

        def keyed(batches):
            frames = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column(1))
                frames = frames or curve_frames(v.shape[1], curves)
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                spread = 3 / np.sqrt(v.shape[1])
                for curve in chosen:
                    turned, shift = frames[curve]
                    place = np.clip((unit @ turned / spread + 1) / 2, 0, 1) + shift  # in 0..2
                    cells = np.minimum((place * (1 << BITS - 1)).astype(np.int64), (1 << BITS) - 1)
                    key = pa.array(hilbert_keys(cells, BITS))
                    columns = [pa.array(np.full(len(v), curve, np.int32)), key, batch.column(0), packed(v, kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "vec_id", "v"])

        order = ["curve", "key", "vec_id"]
        on_curves = rows.mapInArrow(keyed, "curve int, key long, vec_id long, v binary")
        return on_curves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("query", is_query)

    def near_in_order(batches):
        held: list[pa.RecordBatch] = []
        n, fresh = 0, 0

        def compared(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            curve, ids = np.asarray(table["curve"]), np.asarray(table["vec_id"])
            v, query = unpacked(table["v"].combine_chunks(), kind), np.asarray(table["query"])
            stop = len(ids) if last else len(ids) - REACH
            for p in np.flatnonzero(query[fresh:stop]) + fresh:
                window = slice(max(0, p - REACH), p + REACH + 1)
                same = curve[window] == curve[p]
                yield answers(ids[p : p + 1], ids[window][same], nearest_of(v[p : p + 1], ids[p : p + 1], v[window][same], ids[window][same], k))
            keep = max(0, stop - REACH)
            held[:] = table.slice(keep).to_batches()
            return len(ids) - keep, stop - keep

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 14:
                n, fresh = yield from compared(False)
        if n:
            yield from compared(True)

    # The first curve is kept for the check; the others are read once.
    window = int_div(F.monotonically_increasing_id(), WINDOW_ROWS)
    base = stored(on_curve([0]).withColumn("window", window), "curve")
    near = base.drop("key", "window").mapInArrow(near_in_order, FOUND)
    if curves > 1:
        near = near.unionByName(on_curve([*range(1, curves)]).drop("key").mapInArrow(near_in_order, FOUND))
    first = stored(best(near.distinct(), k), "windows")
    # Fewer than k found leaves the bound open.
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    asked = base.filter("query").select(F.col("vec_id").alias("query_id"), "v")
    size = asked.agg(F.count("*").alias("queries"), F.max(F.octet_length("v")).alias("bytes")).first()
    slices = -(-size["queries"] * (size["bytes"] or 0) * 8 // (SLICE_BYTES * np.dtype(kind).itemsize))
    slices = max(1, slices)
    asked = asked.join(bounds, "query_id", "left").withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices).cast("long")))
    asked = stored(asked, "asked")
    merged = first.select("query_id", "vec_id", "score")
    for part in range(slices if size["queries"] else 0):
        merged = merged.unionByName(stored(_checked(base, asked.filter(F.col("slice") == part), kind, k), "checked"))
    merged = merged.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best(merged, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _checked(base: DataFrame, asked: DataFrame, kind: str, k: int) -> DataFrame:
    """The best of each task's rows within the bounds of a slice of queries."""
    table = asked.select("query_id", "v", "bound").toArrow().combine_chunks()
    if not table.num_rows:
        return base.sparkSession.createDataFrame([], FOUND)
    bound = table["bound"].to_numpy().astype(float)
    bound = np.where(np.isnan(bound), np.inf, bound)
    vectors = np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(table.num_rows, -1)
    held = base.sparkSession.sparkContext.broadcast((np.asarray(table["query_id"]), vectors, bound))

    def reread(batches):
        query_ids, vectors, bound = held.value
        near = Nearest(query_ids, vectors.astype(np.float64), bound, k)
        for batch in batches:
            ids, window = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            cuts = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(ids)] if len(ids) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                near.show(ids[lo:hi], unpacked(batch.column(1).slice(lo, hi - lo), kind))
        q, ids, distance = near.settle()
        for lo in range(0, len(q), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            columns = [pa.array(query_ids[q[part]], pa.int64()), pa.array(ids[part], pa.int64()), pa.array(distance[part])]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return base.select("vec_id", "v", "window").mapInArrow(reread, FOUND)
