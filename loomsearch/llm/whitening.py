"""Whitening of embeddings by a matrix-free block Lanczos method.

The covariance is never built. Each step sends a thin block of directions to the
tasks, which multiply it by their own centred rows and by these rows' transpose;
the sums of the parts come back as one thin block. What the driver holds are
these blocks, whose size depends on the vectors' length only. The basis is fully
reorthogonalised, directions that break down are replaced by fresh ones, the
basis is compressed when it is full, and the end is told by residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, only, staged

#: Entries become whole numbers on this grid.
GRID, SHIFT = 64, 1_000_000
#: Components returned, directions in a block, directions at which the basis is compressed.
COMPONENTS, WIDTH, MOST_BASIS = 16, 16, 128
#: Residuals of converged components, as shares of the largest eigenvalue, and passes after which the best there is is taken.
TOLERANCE, MOST_PASSES = 1e-14, 200
#: Eigenvalues below this share of the largest are rounding noise of a smaller space.
LEAST_SHARE = 1e-12
#: Buckets that parts of sums are dealt to before they meet.
BUCKETS = 64

Apply = Callable[[np.ndarray], np.ndarray]


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The block's directions made orthogonal to the basis and to each other; what breaks down starts again as a random direction."""
    out = np.zeros((len(basis), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-13 * size > 0:
                v = v / left
                v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v = rng.standard_normal(len(v))
            size = np.linalg.norm(v)
    return out


def block_lanczos(apply: Apply, size: int, k: int, width: int = WIDTH, most_basis: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric operator ``apply``, falling, and their unit eigenvectors as columns.

    Rayleigh-Ritz on the kept images of the whole basis; a basis of ``size``
    directions spans everything, and the result is exact then.
    """
    k = min(k, size)
    width = min(max(width, k), size)
    most_basis = max(most_basis, 3 * width)
    rng = np.random.default_rng(7)
    basis = images = np.zeros((size, 0))
    block = _orthogonal(rng.standard_normal((size, width)), basis, rng)
    best, stuck = np.inf, 0
    for _ in range(MOST_PASSES):
        image = apply(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, turned = basis @ turns, images @ turns
        worst = np.linalg.norm(turned[:, :k] - ritz[:, :k] * values[:k], axis=0).max(initial=0) / max(values[0], np.finfo(float).tiny)
        stuck = stuck + 1 if worst > best / 2 and worst < 1e-10 else 0  # rounding, which grows with the rows, allows no more
        best = min(best, worst)
        if basis.shape[1] >= size or worst <= TOLERANCE or stuck > 2:
            break
        block = _orthogonal(image[:, : size - basis.shape[1]], basis, rng)
        if basis.shape[1] + width > most_basis:  # the leading directions stay, with their images; the new block leads on
            basis, images = ritz[:, : 2 * width], turned[:, : 2 * width]
    return values[:k], ritz[:, :k] / np.linalg.norm(ritz[:, :k], axis=0)


@dataclass
class Whitening:
    """What whitens: the fit list's size and sums, its centre as whole numbers and rests, eigenvalues, directions as columns, their shares."""

    n: int
    sums: list[int]
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    shares: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n x - S)^2; null where one does not fit a long."""
        sums = np.array(self.sums, object)
        top = int(np.abs(x - self.base).max(initial=0)) + 1
        if (self.n * top) ** 2 * max(1, x.shape[1]) < 1 << 63:
            gap = self.n * (x - self.base) - np.array([s - self.n * int(b) for s, b in zip(self.sums, self.base, strict=True)], np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = (int((g * g).sum()) for g in self.n * x.astype(object) - sums)
        return [g if g < 1 << 63 else None for g in exact]


def on_grid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x``, the vector as whole numbers, of all rows whose vector is whole and finite."""
    own = only(rows, id=id_col, v=vector_col)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    far = float(1 << 62)  # whole numbers end there
    grid = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * GRID, F.lit(far)), F.lit(-far))) + SHIFT)
    return own.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False))).select("id", grid.alias("x"))


def _rows(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``partial`` over all rows: one array a partition, added up in buckets on the executors, so the driver gets a bounded number."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(_rows(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])

    parts = map_arrow(rows.select("x"), step, "part binary").repartition(F.spark_partition_id() % BUCKETS)
    return np.sum([np.frombuffer(r["part"]).reshape(shape) for r in map_arrow(parts, add, "part binary").collect()] or [np.zeros(shape)], axis=0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits the whitening to each distinct vector of ``vectors`` (column ``x``) once; nothing if there is none.

    Repeated vectors count once, so a vector that most rows have does not lead.
    Where vectors differ in length, the fit is on those of the commonest length
    (the shorter one in a tie). Equal eigenvalues share a space, of which any
    unit directions serve.
    """
    lengths = vectors.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").head()
    if lengths is None or lengths["length"] == 0:
        return None
    size = lengths["length"]
    once = staged(vectors.where(F.size("x") == size).select("x").distinct(), "whitening")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = _rows(batch.column(0))
            if len(x):
                small = int(np.abs(x).max()) * len(x) < 1 << 62
                n, total = n + len(x), [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(n), *map(str, total)])], ["k", "part"])

    added = map_arrow(once, sums, "k int, part string").groupBy("k").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["k"]: int(r["total"]) for r in added}
    n, sums_ = found[-1], [found[k] for k in range(size)]
    base = np.array([s // n for s in sums_], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in sums_])
    plan = Whitening(n, sums_, base, rest, np.zeros(0), np.zeros((size, 0)), np.zeros(0), 0.0)

    def apply(block: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            y = plan.centred(x)
            return y.T @ (y @ block)

        return _summed(once, partial, block.shape) / n

    spread = _summed(once, lambda x: (plan.centred(x) ** 2).sum(axis=0)[None], (1, size)).sum() / n  # the trace, from deviations
    values, directions = block_lanczos(apply, size, components)
    kept = values > LEAST_SHARE * max(values.max(initial=0), 0)
    values, directions = values[kept], directions[:, kept]
    scaled = directions / np.sqrt(values)

    def cross(x: np.ndarray) -> np.ndarray:
        w = plan.centred(x) @ scaled
        return w.T @ w

    gram = _summed(once, cross, (len(values), len(values))) / n
    error = float(np.abs(gram - np.eye(len(values))).max(initial=0))
    return Whitening(n, sums_, base, rest, values, directions, values / spread if spread else values, error)


def whiten(vectors: DataFrame, fitted: Whitening | None) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors of another length than the fit's have no rows, nor does anything if
    there was nothing to fit or all vectors are the same. Null ids and repeated
    rows have rows like others; a deviation that does not fit a long is null.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        scaled, k = f.directions / np.sqrt(f.values), len(f.values)
        for batch in batches:
            x = _rows(batch.column(1))
            if not len(x):
                continue
            m = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)),
                pa.array(f.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array((f.centred(x) @ scaled).ravel()), pa.array(np.tile(f.shares, m)),
                pa.array(np.full(m * k, f.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(vectors.where(F.size("x") == len(fitted.base)), step, schema)
