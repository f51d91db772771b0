"""PCA whitening of embeddings without a covariance matrix.

Entries become integers x, so that means and deviations are exact. Eigenvectors of the covariance V
come from a block Lanczos iteration: each step is one distributed pass that multiplies a block by
centred X'X / n, every task adding up its own product; the small rest (orthogonalisation, the projected
matrix) is done on the driver and is bounded by the vectors' length, never by their number. New blocks are
orthogonalised against the whole basis twice; where a block breaks down (its residual has less than full
rank) random directions take the lost places; a basis that grows too large is restarted from its best
Ritz vectors. Iteration ends when all wanted residuals are small or the basis spans the space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

COMPONENTS = 32
#: Columns of a block; more columns take fewer passes.
BLOCK = 32
#: Largest residual of a wanted eigenpair, as a share of the largest eigenvalue.
TOLERANCE = 1e-12
#: Columns of the basis at which it is restarted.
MAX_BASIS = 512
#: Eigenvalues below this share of the largest are zero.
RANK = 1e-13
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size would not fit a long.
LARGEST = float(1 << 62)
LOW_BITS = 31


@dataclass
class Whitening:
    """What fit() has found for vectors of one length."""

    n: int
    sums: list[int]  # of x, exact
    reach: list[int]  # largest distance of x from the rounded mean, by dimension
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    passes: int = 0
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


# ---------------------------------------------------------------- vectors of a batch
def quantised(column: pa.Array):
    """Yields (length, rows, x) for each length of vector: x is an integer matrix of the usable rows."""
    lengths = pc.list_value_length(column)
    known = np.asarray(lengths.fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    for d in np.unique(known[known > 0]):
        rows = np.flatnonzero(known == d)
        flat = column.take(pa.array(rows)).flatten()
        v = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, d) * SCALE
        usable = (np.abs(v) < LARGEST).all(axis=1)  # false for nan too
        yield int(d), rows[usable], np.floor(v[usable]).astype(np.int64) + SHIFT


class Centred:
    """n*x - S and x - S/n of integer vectors. Distances from the rounded mean keep products small."""

    def __init__(self, n: int, sums: list[int], reach: list[int]):
        middle = [(2 * s + n) // (2 * n) for s in sums]
        rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
        self.n, self.fits = n, n * max(reach) + n < 1 << 62
        self.middle = np.array(middle, np.int64)
        self.rest = np.array(rest, np.int64 if self.fits else object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        d = x - self.middle
        return (d if self.fits else d.astype(object)) * self.n - self.rest

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """The rows' sums of (n*x - S)**2: as doubles, and exact where they fit a long, else None."""
        y = self.scaled(x)
        about = (y.astype(np.float64) ** 2).sum(axis=1)
        if self.fits and (about < 2.0**62).all():
            return about, (y * y).sum(axis=1).tolist()
        exact = [sum(int(e) * int(e) for e in row) if a < 2.0**64 else None for row, a in zip(y, about, strict=True)]
        return about, [e if e is not None and e < 1 << 63 else None for e in exact]


# ---------------------------------------------------------------- the iteration
class BlockLanczos:
    """Largest eigenpairs of a symmetric d x d operator that is only seen through its products."""

    def __init__(self, d: int, wanted: int, block: int = BLOCK, max_basis: int = MAX_BASIS, seed: int = 7):
        self.d, self.wanted, self.width = d, min(wanted, d), min(block, d)
        self.max_basis = max(max_basis, 2 * (self.wanted + self.width))
        self.random = np.random.default_rng(seed)
        self.basis = np.zeros((d, 0))
        self.images = np.zeros((d, 0))  # the operator times the basis
        self.block = self.orthogonal(np.zeros((d, 0)), 0.0)
        self.passes = self.breakdowns = self.restarts = 0
        self.done = False
        self.values, self.vectors = np.zeros(0), np.zeros((d, 0))

    def orthogonal(self, new: np.ndarray, size: float) -> np.ndarray:
        """An orthonormal block outside the basis: from what is left of `new`, filled up at random
        where that has lost its rank."""
        width = min(self.width, self.d - self.basis.shape[1])
        out = np.zeros((self.d, 0))
        given = new.shape[1]
        for k in range(given + 4 * self.d):
            if out.shape[1] == width:
                break
            v = new[:, k] if k < given else self.random.standard_normal(self.d)
            least = 1e-10 * size if k < given else 1e-8 * np.linalg.norm(v)
            for _ in range(2):
                v = v - self.basis @ (self.basis.T @ v)
                v = v - out @ (out.T @ v)
            norm = np.linalg.norm(v)
            if norm > least:
                v = v / norm
                v = v - self.basis @ (self.basis.T @ v)
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
            elif k < given:
                self.breakdowns += 1
        return out

    def absorb(self, image: np.ndarray) -> None:
        """Takes the operator's product with the current block."""
        self.passes += 1
        self.basis = np.column_stack([self.basis, self.block])
        self.images = np.column_stack([self.images, image])
        h = self.basis.T @ self.images
        values, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(values, kind="stable")[::-1]
        values, y = values[order], y[:, order]
        k = min(self.wanted, len(values))
        self.values, self.vectors = values[:k], self.basis @ y[:, :k]
        left = self.images @ y[:, :k] - self.vectors * self.values
        size = max(abs(values[0]), abs(values[-1]))
        self.residual = float(np.linalg.norm(left, axis=0).max())
        full = self.basis.shape[1] == self.d
        if full or (k == self.wanted and self.residual <= TOLERANCE * size):
            self.done = True
            return
        rest = image
        for _ in range(2):
            rest = rest - self.basis @ (self.basis.T @ rest)
        if self.basis.shape[1] + self.width > self.max_basis:
            keep = y[:, : self.wanted + self.width]
            q, r = np.linalg.qr(self.basis @ keep)
            self.basis, self.images = q, np.linalg.solve(r.T, (self.images @ keep).T).T
            self.restarts += 1
        self.block = self.orthogonal(rest, size)


# ---------------------------------------------------------------- distributed passes
def _summed(vectors: DataFrame, column: str, task, width: int) -> dict[tuple[int, int], list[float]]:
    """Runs task() (a dict by length of matrices with `width` columns, one for each partition) and
    adds the matrices up; a row of a matrix is a row of the exchange."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in quantised(batch.column(0)):
                for key, m in task(d, x):
                    total[key] = total[key] + m if key in total else m
        for d, m in total.items():
            padded = np.zeros((len(m), width))
            padded[:, : m.shape[1]] = m
            flat = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(m), pa.int64()), pa.array(range(len(m)), pa.int64()), flat], ["d", "j", "v"])

    rows = vectors.select(F.col(column)).mapInArrow(run, "d long, j long, v array<double>")
    sums = rows.groupBy("d", "j").agg(*[F.sum(F.col("v")[c]).alias(f"s{c}") for c in range(width)])
    return {(r[0], r[1]): list(r[2:]) for r in sums.collect()}


def _matrix(sums: dict, d: int, rows: int, width: int) -> np.ndarray:
    return np.array([sums[d, j][:width] for j in range(rows)])


def exact_sums(vectors: DataFrame, column: str) -> dict[int, tuple[int, list[int], list[int]]]:
    """By length: the number of usable vectors, the sums of x and its largest distances from the
    rounded mean, all exact."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in quantised(batch.column(0)):
                if len(rows):
                    t = total.setdefault(d, [0, 0, 0, x[0], x[0]])
                    t[0] += len(rows)
                    t[1] = t[1] + (x >> LOW_BITS).sum(axis=0)
                    t[2] = t[2] + (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
                    t[3], t[4] = np.minimum(t[3], x.min(axis=0)), np.maximum(t[4], x.max(axis=0))
        for d, (n, high, low, least, most) in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "j": range(d), "n": [n] * d, "high": high, "low": low, "least": least, "most": most})

    rows = vectors.select(F.col(column)).mapInArrow(run, "d long, j long, n long, high long, low long, least long, most long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[int, list] = {}
    for r in rows.groupBy("d", "j").agg(wide("n"), wide("high"), wide("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        n, s = int(r.n), (int(r.high) << LOW_BITS) + int(r.low)
        middle = (2 * s + n) // (2 * n)
        out.setdefault(r.d, []).append((r.j, n, s, max(r.most - middle, middle - r.least)))
    return {d: (sorted(x)[0][1], [s for _, _, s, _ in sorted(x)], [a for _, _, _, a in sorted(x)]) for d, x in out.items()}


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, max_basis: int = MAX_BASIS) -> dict[int, Whitening]:
    """Fits each length of vector on all its usable vectors; passes are shared by the lengths. The
    model's size depends on the lengths alone. A length whose vectors are all equal has no component."""
    models: dict[int, Whitening] = {}
    runs: dict[int, BlockLanczos] = {}
    centred: dict[int, Centred] = {}
    for d, (n, sums, reach) in exact_sums(vectors, column).items():
        models[d] = Whitening(n, sums, reach, 0.0, np.zeros(0), np.zeros((d, 0)))
        centred[d] = Centred(n, sums, reach)
        if any(reach):
            runs[d] = BlockLanczos(d, components, block, max_basis)

    first = True
    while open_runs := {d: r.block for d, r in runs.items() if not r.done}:
        with_trace = first

        def multiply(d, x, blocks=open_runs, with_trace=with_trace):
            if d in blocks and len(x):
                c = centred[d](x)
                product = c.T @ (c @ blocks[d])
                if with_trace:  # the deviations' sum, over n * n, as one more row
                    row = np.zeros((1, product.shape[1]))
                    row[0, 0] = centred[d].deviations(x)[0].sum() / centred[d].n / centred[d].n
                    product = np.vstack([product, row])
                yield d, product

        width = max(b.shape[1] for b in open_runs.values())
        sums = _summed(vectors, column, multiply, width)
        for d, b in open_runs.items():
            runs[d].absorb(_matrix(sums, d, d, b.shape[1]) / models[d].n)
            if with_trace:
                models[d].trace = sums[d, d][0] / models[d].n
        first = False

    for d, r in runs.items():
        real = r.values > RANK * max(r.values[0], 0)
        models[d].values, models[d].vectors, models[d].passes = r.values[real], r.vectors[:, real], r.passes
    measured = {d: m for d, m in models.items() if len(m.values)}
    if measured:

        def gram(d, x):
            if d in measured and len(x):
                z = centred[d](x) @ (measured[d].vectors / np.sqrt(measured[d].values))
                yield d, np.vstack([z.T @ z, z.sum(axis=0, keepdims=True)])

        sums = _summed(vectors, column, gram, max(len(m.values) for m in measured.values()))
        for d, m in measured.items():
            k = len(m.values)
            g = _matrix(sums, d, k + 1, k) / m.n
            m.identity_error = float(np.abs(g[:k] - np.outer(g[k], g[k]) - np.eye(k)).max())
    return models


def transform(vectors: DataFrame, models: dict[int, Whitening], column: str = "embedding") -> DataFrame:
    """vectors (column, more) -> their other columns, then n long, deviation long, whitened and
    explained array<double> (by component) and identity_error double.

    Rows whose vector is null, empty, or holds null, non-finite or too large entries (64 times the entry
    does not fit a long) are dropped; a length that fit() has not seen too. deviation is null where it
    does not fit a long. Repeated rows stay, an empty table gives an empty result; other columns keep any
    name but those five, which are replaced. Vectors are compared with those of their length only."""
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    keep = [f.name for f in vectors.schema if f.name not in (column, *new)]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    kept = F.struct(*[F.col(quoted(c)) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = vectors.select(F.col(quoted(column)).alias("vector"), kept.alias("keep"))

    def run(batches):
        centred = {d: Centred(m.n, m.sums, m.reach) for d, m in models.items()}
        for batch in batches:
            for d, at, x in quantised(batch.column(0)):
                if d not in models or not len(at):
                    continue
                m, k = models[d], len(models[d].values)
                z = centred[d](x) @ (m.vectors / np.sqrt(m.values))
                lists = lambda a: pa.ListArray.from_arrays(pa.array(range(0, k * len(at) + 1, max(k, 1)) if k else [0] * (len(at) + 1), pa.int32()), pa.array(a.ravel(), pa.float64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(at)), pa.array([m.n] * len(at), pa.int64()), pa.array(centred[d].deviations(x)[1], pa.int64()), lists(z), lists(np.tile(m.explained, (len(at), 1))), pa.array([m.identity_error] * len(at), pa.float64())],
                    ["keep", *new],
                )

    doubles = ArrayType(DoubleType())
    schema = StructType([rows.schema["keep"], *(StructField(c, t) for c, t in zip(new, (LongType(), LongType(), doubles, doubles, DoubleType()), strict=True))])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("keep." + quoted(c)).alias(c) for c in keep], *new)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    done = transform(vectors, fit(vectors))
    by = done.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return by.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
