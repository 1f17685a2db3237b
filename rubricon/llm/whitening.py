"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

An entry c becomes the integer floor(64 c) + 1000000, so counts, sums and deviations are exact.
The fit list holds each distinct integer vector once, stored in blocks of `BLOCK_ROWS`. Let X be
its rows less their mean. Starting with a unit vector v1, the alternating products

    alpha_k u_k = X v_k - beta_(k-1) u_(k-1),    beta_k v_(k+1) = X' u_k - alpha_k v_k

give an upper bidiagonal matrix B with X V = U B. Left vectors are as long as the corpus and are
never stored: u_k = X y_k, with y_k of the length of a vector, so each block makes its part of all
u again from what the driver sends. One distributed pass a step returns the products with X' and
with all earlier u; both sides are fully reorthogonalised by them. The SVD of B, whose size is the
number of steps, gives components and deviations. The steps end when the wanted components have
converged and all that the steps have not reached has less variance than the last of these, or
when V spans the whole space. Only vectors and matrices of the embedding's dimension meet the
driver.

Rows whose vector is null, empty or holds a null or non-finite entry take no part and are not
returned; neither are rows with another dimension than the commonest (ties: the larger). Integers
are held within 32 bits. Repeated rows are all returned. Components without variance (fewer
distinct vectors than dimensions, constant columns) are absent, so a table of equal vectors gives
no rows; so does an empty one. Deviations beyond 64 bits are null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.bpe import with_column
from rubricon.session import stored

SCALE, OFFSET = 64, 1_000_000
BLOCK_ROWS = 4096
#: Relative residual at which a component counts as converged.
TOLERANCE = 1e-14
#: A variance below this share of the largest is rounding.
NO_VARIANCE = 1e-13


@dataclass
class Whitening:
    """A fitted whitening: list length, exact sums, components (columns), variances and checks."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Rows with a usable vector and their integer vectors; see the module's text."""
    c = F.col(vector).cast("array<double>")
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0)
    held = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(SCALE * x, F.lit(-2.0**40)), F.lit(2.0**40))) + OFFSET, F.lit(-(2**31))), F.lit(2**31 - 1))
    rows = df.filter(F.coalesce(good, F.lit(False)))
    return rows.withColumn(out, F.transform(c, lambda x: held(x).cast("int")))


def fit_list(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(blocks of distinct integer vectors as binary, dimension); dimension 0 for no rows."""
    rows = integers(df.select(vector), vector, "x").select("x")
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = int(top["d"]) if top else 0

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column("x").flatten(), "<i4").reshape(-1, d))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block(held)
                held = []
        if held:
            yield block(held)

    def block(held):
        whole = np.concatenate(held)
        parts = [whole[k : k + BLOCK_ROWS] for k in range(0, len(whole), BLOCK_ROWS)]
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], ["block"])

    return stored(rows.filter(F.size("x") == d).distinct().mapInArrow(run, "block binary"), "fit-list"), d


def pass_over(blocks: DataFrame, d: int, work, width: int) -> np.ndarray:
    """The sum over all blocks of `work(integer block)`, `width` doubles each; added up in tasks."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for raw in batch.column("block"):
                total += work(np.frombuffer(raw.as_buffer(), "<i4").reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = blocks.mapInArrow(run, "sums binary").toArrow().column("sums")
    return np.sum([np.frombuffer(r.as_buffer()) for r in rows], axis=0) if len(rows) else np.zeros(width)


def exact_sums(blocks: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(rows, per-dimension sums); sums of 32-bit integers are exact in 64 bits."""

    def run(batches):
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            for raw in batch.column("block"):
                x = np.frombuffer(raw.as_buffer(), "<i4").reshape(-1, d)
                n, total = n + len(x), total + x.sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    rows = blocks.mapInArrow(run, "n long, sums binary").toArrow()
    sums = [np.frombuffer(r.as_buffer(), np.int64) for r in rows.column("sums")]
    return sum(rows.column("n").to_pylist()), np.sum(sums, axis=0) if sums else np.zeros(d, np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows less the mean, from the exact n x - S where 64 bits hold it."""
    if n < 1 << 31:
        return (x.astype(np.int64) * n - sums) / n
    return x - sums / n


def without(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v less its parts along the orthonormal columns of `basis`, taken out twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


class Bidiagonal:
    """The state of the alternating products on the driver: V, B, and y and X'u of every left vector."""

    def __init__(self, blocks: DataFrame, d: int, n: int, sums: np.ndarray):
        self.blocks, self.d, self.n, self.sums = blocks, d, n, sums
        self.draw = np.random.default_rng(7)
        self.v, self.y, self.back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
        self.alpha: list[float] = []
        self.beta: list[float] = []

    def products(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(U'Xz, X'Xz, |Xz|^2) in one pass."""
        n, sums, k, right = self.n, self.sums, self.y.shape[1], np.column_stack([self.y, z])

        def work(block):
            x = centred(block, n, sums)
            left = x @ right
            return np.concatenate([left.T @ left[:, -1], x.T @ left[:, -1]])

        got = pass_over(self.blocks, self.d, work, k + 1 + self.d)
        return got[:k], got[k + 1 :], float(got[k])

    def fresh(self) -> np.ndarray | None:
        """A unit vector outside of V; None where V spans the space."""
        if self.v.shape[1] >= self.d:
            return None
        v = without(self.draw.normal(size=self.d), self.v)
        return v / np.linalg.norm(v)

    def step(self, v: np.ndarray, beta: float, tiny: float) -> tuple[np.ndarray | None, float]:
        """Takes v in as the next right vector (tied to the last left one by beta); returns the one after it and its beta."""
        z = v - beta * self.y[:, -1] if beta else v.copy()
        while True:
            along, back, square = self.products(z)
            z, back = z - self.y @ along, back - self.back @ along
            rest = square - along @ along
            if along @ along <= 1e-6 * max(rest, 0.0) or rest <= tiny**2:
                break
        alpha = float(np.sqrt(max(rest, 0.0)))
        self.v = np.column_stack([self.v, v])
        self.beta.append(beta)
        if alpha <= tiny:  # X has nothing more along v
            self.alpha.append(0.0)
            self.y, self.back = np.column_stack([self.y, np.zeros(self.d)]), np.column_stack([self.back, np.zeros(self.d)])
            return self.fresh(), 0.0
        self.alpha.append(alpha)
        self.y, self.back = np.column_stack([self.y, z / alpha]), np.column_stack([self.back, back / alpha])
        ahead = without(back / alpha, self.v)
        beta = float(np.linalg.norm(ahead))
        if self.v.shape[1] >= self.d:
            return None, 0.0
        return (ahead / beta, beta) if beta > tiny else (self.fresh(), 0.0)

    def svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(singular values, right vectors as columns, last row of the left factor)."""
        b = np.diag(self.alpha) + np.diag(self.beta[1:], 1)
        left, s, right = np.linalg.svd(b)
        return s, self.v @ right.T, left[-1]


def bidiagonalise(blocks: DataFrame, d: int, n: int, sums: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, variances, total variance), by falling variance, `wanted` at most."""

    def squares(block):
        x = centred(block, n, sums)
        return np.array([np.einsum("ij,ij->", x, x)])

    trace = float(pass_over(blocks, d, squares, 1)[0])
    if trace <= 0:
        return np.zeros((d, 0)), np.zeros(0), 0.0
    state, tiny = Bidiagonal(blocks, d, n, sums), np.sqrt(trace) * 1e-13
    v, beta = state.fresh(), 0.0
    while v is not None:
        v, beta = state.step(v, beta, tiny)
        s, _, last = state.svd()
        if len(s) >= wanted:
            unreached = trace - float(np.sum(np.square(state.alpha)) + np.sum(np.square(state.beta)))
            settled = np.abs(beta * last[:wanted]) <= TOLERANCE * s[0]
            if settled.all() and unreached < s[wanted - 1] ** 2:
                break
    s, right, _ = state.svd()
    keep = min(wanted, int((s**2 > NO_VARIANCE * s[0] ** 2).sum()))
    return right[:, :keep], s[:keep] ** 2 / n, trace / n


def fit(df: DataFrame, vector: str = "embedding", wanted: int = 16) -> Whitening:
    """The whitening of the distinct integer vectors of `df`."""
    blocks, d = fit_list(df, vector)
    n, sums = exact_sums(blocks, d) if d else (0, np.zeros(0, np.int64))
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    components, variances, total = bidiagonalise(blocks, d, n, sums, wanted)
    k = len(variances)
    if not k:
        return Whitening(n, sums, components, variances, np.zeros(0), 0.0)
    scaled = components / np.sqrt(variances)

    def covariance(block):
        w = centred(block, n, sums) @ scaled
        return (w.T @ w).ravel()

    error = np.abs(pass_over(blocks, d, covariance, k * k).reshape(k, k) / n - np.eye(k)).max()
    return Whitening(n, sums, components, variances, variances / total, float(error))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 of each row, exact; null beyond 64 bits."""
    if n < 1 << 31:
        off = x.astype(np.int64) * n - sums
        size = np.square(off.astype(np.float64)).sum(1)
        fits = size < 9.2e18
        return pa.array(np.square(np.where(fits[:, None], off, 0)).sum(1), pa.int64(), mask=~fits)
    exact = [sum((int(a) * n - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", deviation: str = "deviation", whitened: str = "whitened") -> DataFrame:
    """Adds each row's exact squared deviation and its whitened coordinates (array, falling variance).

    Only rows with a usable vector of the fitted dimension are returned. Columns with the names of
    the added ones are replaced."""
    d, x = len(model.sums), "x"
    while x.lower() in (c.lower() for c in df.columns):
        x = f"_{x}"
    rows = integers(df.drop(deviation, whitened), vector, x).filter(F.size(x) == max(d, 1))
    scaled = model.components / np.sqrt(model.variances)
    n, sums = model.n, model.sums

    def run(batches):
        for batch in batches:
            block = np.asarray(batch.column(x).flatten(), np.int64).reshape(batch.num_rows, -1)
            places = centred(block, n, sums) @ scaled
            bounds = pa.array(np.arange(len(block) + 1) * places.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(places.ravel(), pa.float64()))
            rest = batch.select([c for c in batch.schema.names if c != x])
            yield with_column(with_column(rest, deviation, deviations(block, n, sums)), whitened, lists)

    kinds = {deviation: F.lit(None).cast("long"), whitened: F.lit(None).cast("array<double>")}
    schema = rows.drop(x).withColumns(kinds).schema
    return rows.mapInArrow(run, schema) if n else df.sparkSession.createDataFrame([], schema)


def whiten(df: DataFrame, vector: str = "embedding", wanted: int = 16) -> DataFrame:
    """A row for each usable row of `df` and component: component (from 1), n, deviation, whitened,
    explained, identity_error beside the columns of `df`, of which those with such names are replaced."""
    model = fit(df, vector, wanted)
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    base = df.drop(*(c for c in df.columns if c.lower() in added and c != vector))
    rows = transform(base, model, vector)
    shares = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    return rows.select(
        *(F.col(c) for c in rows.columns if c not in ("deviation", "whitened")),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.lit(model.identity_error).alias("identity_error"),
        F.inline(F.transform("whitened", lambda w, k: F.struct((k + 1).alias("component"), w.alias("whitened"), F.element_at(shares, (k + 1).cast("int")).alias("explained")))),
    )
