"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance matrix is never built. A pass over the distinct vectors multiplies it
with a block of columns: every task adds up Xᵀ(XQ) of its centred rows. A Chebyshev
polynomial of such passes damps the part of the spectrum below the block and blows up
the wanted end; QR and Rayleigh-Ritz follow, until the residuals of the wanted pairs
are at rounding level (or stop falling). Each round swaps the last guard column for a
new random one, so that no direction stays out of the block by chance.

Integers: entry c becomes x = floor(256 * c). n, the sums S and the squared deviations
are exact; covariances are of x - S/n in double.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries
are left out, and so are vectors of another length than the most frequent one (of equal
counts the longer). Products beyond a long are cut to its range. Repeated vectors enter
the fit once, but every row is returned, rows with a null or repeated vec_id too. With
fewer than ``components`` dimensions, that many components. A component without
variance (rounding level) has a null ``whitened``, and takes no part in
``identity_error``; without any variance ``explained`` is null. A deviation beyond the
range of a long is null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpflow.llm.blocks import sum_blocks
from chirpflow.session import read_table, scratch_path

COMPONENTS = 4
#: Columns carried beside the wanted ones; a wider block needs fewer passes.
GUARD = 28
#: Largest spread of amplification inside one filter, and its largest degree.
MAX_SPREAD = 1e8
MAX_DEGREE = 32
MAX_ROUNDS = 200
ROWS_AT_ONCE = 8192
NARROW = np.int16
OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) for each length that occurs among the sound vectors of a list column."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    sound = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(256.0 * values)
    top = np.nextafter(2.0**63, 0)
    whole = np.clip(np.nan_to_num(scaled, nan=0.0, posinf=top, neginf=-(2.0**63)), -(2.0**63), top).astype(np.int64)
    for length in np.unique(lengths[sound]).tolist():
        at = np.flatnonzero(sound & (lengths == length))
        yield at, whole[(ends[at] - length)[:, None] + np.arange(length)]


def to_keys(matrix: np.ndarray) -> list[bytes]:
    """One binary key a row: 2 bytes an entry where the row's entries fit, else 8 (equal rows, equal keys)."""
    info = np.iinfo(NARROW)
    fits = ((matrix >= info.min) & (matrix <= info.max)).all(axis=1)
    short = matrix.astype(NARROW)
    return [(short[i] if ok else matrix[i]).tobytes() for i, ok in enumerate(fits.tolist())]


def from_keys(keys: list[bytes], dim: int) -> np.ndarray:
    """The integer matrix of binary keys."""
    narrow = 2 * dim
    if all(len(k) == narrow for k in keys):
        return np.frombuffer(b"".join(keys), dtype=NARROW).reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(k, dtype=NARROW if len(k) == narrow else np.int64) for k in keys], dtype=np.int64).reshape(-1, dim)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from_keys(batch.column(0).slice(start, ROWS_AT_ONCE).to_pylist(), dim)


def write_keys(rows: DataFrame) -> DataFrame:
    """vec_id, dim, key of every sound row, written to the shared folder."""
    spark = rows.sparkSession
    path = scratch_path(spark, "whitening-rows")
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in quantised(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([matrix.shape[1]] * len(at), pa.int32()), pa.array(to_keys(matrix), pa.binary())],
                    ["vec_id", "dim", "key"],
                )

    rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_type}, dim int, key binary").write.parquet(path)
    return spark.read.parquet(path)


class Covariance:
    """Covariance of the distinct vectors of a table of keys, known by its products only."""

    def __init__(self, fit: DataFrame, dim: int):
        self.fit, self.dim, self.passes = fit, dim, 0
        self.tasks = fit.rdd.getNumPartitions()

        def sums(batches: Iterator[pa.RecordBatch]):
            total = None
            for m in _matrices(batches, dim):
                low, high = m & 0xFFFFFFFF, m >> 32
                part = high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
                block = (np.array([len(m)], dtype=object), part)
                total = block if total is None else tuple(a + b for a, b in zip(total, block, strict=True))
            return total

        n, s = sum_blocks(fit, sums, self.tasks)
        self.n, self.sums = int(n[0]), [int(v) for v in s]
        self.mean = np.array([v / self.n for v in self.sums])
        self.trace = float(self._over_rows(lambda y: (np.array([np.einsum("ij,ij->", y, y)]),))[0][0]) / self.n

    def _over_rows(self, of_centred) -> tuple[np.ndarray, ...]:
        dim, mean = self.dim, self.mean

        def block(batches: Iterator[pa.RecordBatch]):
            total = None
            for m in _matrices(batches, dim):
                part = of_centred(m - mean)
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
            return total

        return sum_blocks(self.fit, block, self.tasks)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times a block of columns: one pass over the rows."""
        self.passes += 1
        return self._over_rows(lambda y: (y.T @ (y @ q),))[0] / self.n

    def identity_error(self, axes: np.ndarray) -> float:
        """Largest entry of the covariance of the rows' coordinates on ``axes`` minus the identity."""
        total, square = self._over_rows(lambda y: ((y @ axes).sum(axis=0), (y @ axes).T @ (y @ axes)))
        mean = total / self.n
        return float(np.abs(square / self.n - np.outer(mean, mean) - np.eye(axes.shape[1])).max())


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values falling, Ritz vectors, and the covariance times them, of an orthonormal block."""
    t = q.T @ vq
    values, w = np.linalg.eigh((t + t.T) / 2)
    w = w[:, ::-1]
    return values[::-1], q @ w, vq @ w


def growth(value: float, cut: float) -> float:
    """Amplification a degree of a value above the damped interval [0, cut]."""
    x = max(2.0 * value / cut - 1.0, 1.0)
    return x + np.sqrt(x * x - 1.0)


def chebyshev(times, q: np.ndarray, vq: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small on [0, cut], applied to q (vq: first product)."""
    half = cut / 2.0
    before, now = q, vq / half - q
    for _ in range(degree - 1):
        before, now = now, 2.0 * (times(now) / half - now) - before
    return now


def leading_pairs(cov: Covariance, wanted: int, guard: int = GUARD, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues (falling), unit eigenvectors, and the largest residual over the largest value."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, cov.dim)
    width = min(cov.dim, wanted + guard)
    q = np.linalg.qr(rng.standard_normal((cov.dim, width)))[0]
    floor = 16 * np.finfo(float).eps * np.sqrt(cov.dim)
    best, stale, kept = np.inf, 0, None
    for _ in range(MAX_ROUNDS):
        values, q, vq = rayleigh_ritz(q, cov.times(q))
        scale = max(values[0], np.finfo(float).tiny)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / scale)
        stale = 0 if residual < 0.5 * best else stale + 1
        if residual < best:
            best, kept = residual, (values[:wanted].copy(), q[:, :wanted].copy())
        if best <= floor or (best < 1e-12 and stale >= 2) or width == cov.dim or values[0] <= 0:
            break
        cut = max(values[-1], scale * 1e-14)
        spread = growth(values[0], cut) / growth(values[wanted - 1], cut)
        degree = MAX_DEGREE if spread <= 1.0 else max(2, min(MAX_DEGREE, int(np.log(MAX_SPREAD) / np.log(spread))))
        q = chebyshev(cov.times, q, vq, cut, degree)
        q /= np.linalg.norm(q, axis=0)
        q[:, -1] = rng.standard_normal(cov.dim)
        q = np.linalg.qr(q)[0]
    else:
        raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds, residual {best:.1e}")
    values, vectors = kept
    return np.maximum(values, 0.0), vectors, best


def deviations(matrix: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where it is beyond a long.

    Arithmetic modulo 2^64 is exact for results below 2^63; a double tells which those are."""
    with np.errstate(over="ignore"):
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in sums], dtype=np.int64)
        part = matrix * np.int64((n + 2**63) % 2**64 - 2**63) - wrapped
        exact = (part * part).sum(axis=1).tolist()
        size = (((matrix - mean) * float(n)) ** 2).sum(axis=1) / 2.0**63
    out: list[int | None] = exact
    for i in np.flatnonzero(size > 1 - 1e-6).tolist():
        value = None if size[i] > 1 + 1e-6 else sum((n * int(x) - s) ** 2 for x, s in zip(matrix[i].tolist(), sums, strict=True))
        out[i] = value if value is not None and value < 2**63 else None
    return out


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each sound row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = OUT.format(id=id_type)
    table = write_keys(rows)
    lengths = table.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["dim"]
    table = table.where(F.col("dim") == dim)
    path = scratch_path(spark, "whitening-fit")
    table.select("key").distinct().write.parquet(path)
    cov = Covariance(spark.read.parquet(path), dim)
    values, vectors, _ = leading_pairs(cov, components)
    sound = values > max(cov.trace, 0.0) * 1e-13
    axes = np.where(sound, vectors / np.sqrt(np.where(sound, values, 1.0)), 0.0)
    error = cov.identity_error(axes[:, sound]) if sound.any() else None
    n, sums, mean = cov.n, cov.sums, cov.mean
    explained = [float(v / cov.trace) if cov.trace > 0 else None for v in values]
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                m = from_keys(part.column(1).to_pylist(), dim)
                rows_ = len(m)
                white = pa.array(((m - mean) @ axes).ravel(), mask=np.tile(~sound, rows_))
                dev = pa.array(deviations(m, n, sums, mean), pa.int64())
                each = pa.array(np.repeat(np.arange(rows_), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                        pa.array(np.full(rows_ * k, n, dtype=np.int64)),
                        dev.take(each),
                        white,
                        pa.array(explained * rows_, pa.float64()),
                        pa.array([error] * (rows_ * k), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.select("vec_id", "key").mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
