"""Embedding whitening by spectral divide and conquer.

Two passes over the table gather the sums and the centred cross products; each task adds up its own rows and only one
matrix per task meets in the shuffle.  The covariance (dimensions x dimensions, whatever the number of rows) is then split
on the driver: the polar factor of the covariance shifted by a number between its eigenvalues is a matrix of signs, half of
it plus the identity projects onto the eigenvectors above the shift.  A basis of that subspace and of its complement cut the
matrix into two smaller ones, and so on down to single components.  The polar factor comes from the dynamically weighted
Halley iteration in its form with QR factors.  The components are broadcast, and a last pass projects every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import stash

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components asked for.
COMPONENTS = 32
#: Broadcast bound: dimensions of an embedding. The driver holds one matrix of that size.
MOST_DIMENSIONS = 4096
#: Scaled entries beyond this are not exact as double any more; they count as this one.
MOST_ENTRY = 1 << 52
#: Rows handled at once in a task.
_ROWS = 2048
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix that is not zero, by the QR form of the weighted Halley iteration."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # A lower bound of the smallest singular value; a wrong one only costs rounds, so a singular matrix gets the smallest.
    low = max(1.0 / (np.linalg.norm(np.linalg.pinv(x, rcond=_EPS)) or 1.0), _EPS) if n < 512 else _EPS
    unit = np.eye(n)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square)) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, unit]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if abs(1 - low) < 1e-12 and step < 1e-8 * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator):
    """Orthonormal bases of two complementary invariant subspaces, or null where all eigenvalues are one to rounding.

    ``a`` is part of a matrix whose largest entry is one.
    """
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= n * _EPS * max(abs(mean), np.linalg.norm(a) / np.sqrt(n)):
        return None
    diagonal = np.diag(a)
    for shift in (np.median(diagonal), mean, *rng.uniform(diagonal.min(), diagonal.max(), 20)):
        moved = a - shift * np.eye(n)
        if not np.any(moved):
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = projector @ rng.standard_normal((n, n))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis[:, :rank] if basis.shape[1] >= rank else basis)
        full, _ = np.linalg.qr(np.hstack([basis[:, :rank], (np.eye(n) - projector) @ rng.standard_normal((n, n - rank))]))
        left, right = full[:, :rank], full[:, rank:]
        if np.linalg.norm(right.T @ a @ left) <= 100 * n * _EPS * np.linalg.norm(a):
            return left, right
    if spread > 1000 * n * _EPS:
        raise ArithmeticError("no shift splits the covariance")
    return None


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    rng = np.random.default_rng(7)
    size, values, vectors = max(np.abs(a).max(initial=0.0), np.finfo(float).tiny), [], []
    open_parts = [(a / size, np.eye(len(a)))]
    while open_parts:
        part, basis = open_parts.pop()
        halves = _split(part, rng) if len(part) > 1 else None
        if halves is None:
            values.extend(np.diag(part))
            vectors.append(basis)
            continue
        for half in halves:
            inner = half.T @ part @ half
            open_parts.append(((inner + inner.T) / 2, basis @ half))
    vectors = np.hstack(vectors) if vectors else np.zeros((0, 0))
    if len(a):
        vectors, _ = np.linalg.qr(vectors)
        values = np.einsum("ij,ij->j", vectors, a @ vectors)
    values = np.asarray(values, float)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(batch: pa.RecordBatch, at: int, dims: int):
    """Pieces of a batch with the scaled vectors as rows of int64."""
    column = batch.column(at)
    for first in range(0, batch.num_rows, _ROWS):
        part = column.slice(first, _ROWS)
        yield first, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def scaled_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors in whole numbers.

    Rows are left out where the vector is null, empty, or holds null, NaN or infinite entries.  Entries count as 2^52 at
    most, scaled (and -2^52 at least), the range in which doubles are whole numbers.
    """
    vector = F.col(vector_col)
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = F.lit(float(MOST_ENTRY))
    entry = lambda c: F.floor(F.greatest(-bound, F.least(bound, F.lit(SCALE) * c.cast("double")))) + F.lit(OFFSET)
    return rows.where(vector.isNotNull() & (F.size(vector) > 0) & fine).select(
        F.col(id_col).alias("vec_id"), F.transform(vector, entry).alias("x"))


def _fit_list(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """The scaled vectors of the most frequent length (the longer one of two), their length and number."""
    vectors = stash(scaled_vectors(rows, id_col, vector_col), "vectors")
    found = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return vectors, 0, 0
    if found.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {found.d} dimensions; one matrix of at most {MOST_DIMENSIONS} is split on the driver")
    return vectors.where(F.size("x") == found.d), found.d, found.n


def _sums(vectors: DataFrame, dims: int) -> list[int]:
    def run(stream):
        total = [0] * dims
        for batch in stream:
            for _, x in _matrix(batch, 0, dims):
                high, low = x >> 20, x & 0xFFFFF
                total = [t + (int(h) << 20) + int(s) for t, h, s in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], names=["i", "s"])

    parts = vectors.select("x").mapInArrow(run, "i int, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(found, key=lambda r: r.i)]


def _cross_products(vectors: DataFrame, column: str, dims: int, centre) -> np.ndarray:
    """Sum over all rows of the outer products of ``centre(rows)``; one matrix per task, added by Spark."""
    def run(stream):
        total, seen = np.zeros((dims, dims)), False
        for batch in stream:
            for _, x in _matrix(batch, 0, dims):
                y = centre(x)
                total += y.T @ y
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = vectors.select(column).mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for r in cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect():
        out[r.i] = [c.v for c in r.row]
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as double: the whole part is taken off in whole numbers first, so no digit is lost."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    ``deviation`` is ``decimal(38,0)``; ``n`` is the number of rows of the fit.  Rows with a null or empty vector or with null,
    NaN or infinite entries are left out, as are rows whose length is not the most frequent one.  Repeated rows and ids count
    and appear as often as they stand; a null id stays null.  Components whose eigenvalue is zero to rounding (constant or
    dependent dimensions) cannot be whitened and are left out, so fewer than ``components`` may come; equal vectors or a
    single row give no rows, as does an empty table.  Components with equal eigenvalues are an arbitrary basis of their
    space.  Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    schema = (f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    vectors, dims, n = _fit_list(rows, id_col, vector_col)
    if not n:
        return spark.createDataFrame([], schema)
    sums = _sums(vectors, dims)
    covariance = _cross_products(vectors, "x", dims, lambda x: _centred(x, n, sums)) / n
    values, axes = spectral_components(covariance)
    kept = int(np.sum(values > dims * _EPS * max(values[0], 0.0)))
    kept = min(kept, components)
    if not kept:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((axes[:, :kept] / np.sqrt(values[:kept]), sums))
    explained = (values[:kept] / np.trace(covariance)).tolist()

    def project(stream):
        turn, total = sent.value
        whole = np.array([s // n for s in total], np.int64)
        rest = np.array([s % n for s in total], np.int64)
        for batch in stream:
            for first, x in _matrix(batch, 1, dims):
                z = _centred(x, n, total) @ turn
                # n x - S = n (x - whole) - rest; exact in Python integers where 64 bits could overflow.
                gap = x - whole
                top = int(np.abs(gap).max(initial=0)) * n + n
                if top * top * dims < 2 ** 63:
                    off = ((gap * n - rest) ** 2).sum(1).tolist()
                else:
                    off = [sum((n * int(g) - int(r)) ** 2 for g, r in zip(row, rest)) for row in gap]
                off = [str(v) if v < 10 ** 38 else None for v in off]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(x)), pa.array(off, pa.string()),
                     pa.array(list(z), pa.list_(pa.float64()))], names=["vec_id", "deviation", "z"])

    done = vectors.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation string, z array<double>")
    done = stash(done, "whitened")
    spread = _cross_products(done, "z", kept, lambda z: z) / n
    means = np.array(done.select(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(kept)]).first())
    error = float(np.abs(spread - np.outer(means, means) - np.eye(kept)).max())
    shares = F.array(*[F.lit(e) for e in explained])
    return done.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias(
        "at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
