"""Operator 12: whitening of vectors by spectral divide and conquer with QDWH polar decompositions.

Spark reduces the vectors to their covariance: distinct fixed-point vectors are stored once, counted and
summed exactly, then their centred products are added up task by task and merged in two levels.  What
reaches the driver is one d x d matrix.  There the polar factor U of ``V - s I`` (QDWH: dynamically
weighted Halley steps, each a QR factorisation) gives the spectral projector ``(U + I) / 2`` of the
eigenvalues above s; its range and complement split the matrix in two, and so on down to single
components.  The whitening matrix is broadcast and applied to each row where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_pass, share, shared, table

EPS = np.finfo(np.float64).eps
SCALE, SHIFT = 64, 1000000
MAX_LONG = (1 << 63) - 1


# Spectral divide and conquer -------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Converges in six steps or so whatever the condition; a singular matrix leaves the null directions at
    arbitrary values in [-1, 1], which the caller notices.
    """
    n = len(a)
    bound = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x = a / bound
    # A cautious lower bound of the smallest singular value; too small a one only costs a step.
    low = min(max(np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / n, EPS), 1.0)
    eye = np.eye(n)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.abs(new - x).max()
        x = new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < 10 * EPS and 1 - low < 10 * EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift, or None if the shift splits nothing."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n or np.abs(projector @ projector - projector).max() > 1e-8:
        return None
    # Columns of the projector span its range; a random mixture of them is well conditioned.
    mix = np.random.default_rng(n).standard_normal((n, n))
    upper = np.linalg.qr(projector @ mix[:, :rank])[0]
    upper = np.linalg.qr(projector @ upper)[0]
    rest = mix[:, rank:] - projector @ mix[:, rank:]
    rest -= upper @ (upper.T @ rest)
    lower = np.linalg.qr(rest)[0]
    lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
    return (upper, lower) if np.abs(upper.T @ a @ lower).max() <= 1e-12 * scale else None


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and the unit eigenvectors (columns) of a symmetric matrix."""
    n = len(v)
    scale = max(float(np.abs(v).max()), np.finfo(np.float64).tiny)
    basis, todo = np.eye(n), [(0, n)]
    a = (v + v.T) / 2
    while todo:
        lo, hi = todo.pop()
        block = basis[:, lo:hi].T @ a @ basis[:, lo:hi]
        block = (block + block.T) / 2
        off = np.abs(block - np.diag(np.diag(block))).max() if hi - lo > 1 else 0.0
        if off <= EPS * scale:
            continue
        values = np.diag(block)
        mean, spread = values.mean(), np.abs(block - values.mean() * np.eye(hi - lo)).max()
        split = None
        # The median halves the work; where it falls on an eigenvalue, places near the mean part the rest.
        for shift in (float(np.median(values)), *(mean + k * 0.037 * spread for k in (0, 1, -1, 2, -2, 3, -3, 5, -5))):
            split = _halves(block, shift, scale)
            if split is not None:
                break
        if split is None:
            # Eigenvalues too close to part by projectors of this precision: plane rotations end it.
            turn = _rotations(block)
            basis[:, lo:hi] = basis[:, lo:hi] @ turn
            continue
        upper, lower = split
        basis[:, lo:hi] = basis[:, lo:hi] @ np.hstack([upper, lower])
        middle = lo + upper.shape[1]
        todo += [(lo, middle), (middle, hi)]
    # Rounding of the products of bases is taken back by one more orthogonalisation.
    q, r = np.linalg.qr(basis)
    basis = q * np.sign(np.diag(r))
    values = np.einsum("ij,ik,kj->j", basis, a, basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


def _rotations(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a small cluster by plane rotations."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for _ in range(60):
        off = np.abs(np.triu(a, 1))
        if off.max() <= EPS * np.abs(a).max():
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j] == 0:
                    continue
                angle = 0.5 * math.atan2(2 * a[i, j], a[j, j] - a[i, i])
                c, s = math.cos(angle), math.sin(angle)
                turn = np.array([[c, s], [-s, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                q[:, [i, j]] = q[:, [i, j]] @ turn
    return q


# Sums over Spark ---------------------------------------------------------------------------------


def fixed_point(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector holds only finite numbers, with ``x``: floor(64 * c) + 1000000 of each entry.

    Dropped are null and empty vectors, null or non-finite entries, entries beyond 2^52, and vectors that
    are not as long as most are (of two lengths as frequent, the larger counts).
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c) < float(1 << 52), F.lit(False))), F.lit(False)) & (F.size(v) > 0)
    d = df.where(usable)
    sizes = d.groupBy(F.size(f"`{vector_col}`").alias("n")).count()
    most = sizes.agg(F.max(F.struct("count", "n")).alias("m")).first()["m"]
    dim = most["n"] if most is not None else 0
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return d.where(F.size(f"`{vector_col}`") == dim).withColumn("x", x)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def _added(parts: DataFrame, kind) -> np.ndarray:
    """The rows (i, value) of all tasks added up cell by cell in Spark; the driver gets one matrix."""
    total = (
        parts.select("i", F.posexplode("value").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    )
    cells = total.toArrow()
    i, j = (cells.column(c).to_numpy() for c in ("i", "j"))
    out = np.zeros((int(i.max()) + 1, int(j.max()) + 1), kind) if len(i) else np.zeros((0, 0), kind)
    out[i, j] = cells.column("value").to_numpy()
    return out


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums by dimension."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield {"i": [0], "value": [[n, *total.tolist()]]}

    out = _added(arrow_pass(fit, step, "i int, value array<long>"), np.int64)
    return (int(out[0, 0]), out[0, 1:]) if out.size else (0, np.zeros(0, np.int64))


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n, from whole numbers: the whole part of the mean goes first, exactly."""
    whole, rest = total // n, total % n
    return (x - whole).astype(np.float64) - rest / n


def covariance(fit: DataFrame, n: int, total: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their images under ``turn``."""
    packed = share(fit.sparkSession, (n, total, turn))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count, sums, by = shared(packed)
        out = None
        for batch in batches:
            if batch.num_rows:
                c = _centred(_matrix(batch.column(0), np.int64), count, sums)
                c = c if by is None else c @ by
                out = c.T @ c if out is None else out + c.T @ c
        if out is not None:
            yield {"i": range(len(out)), "value": [r / count for r in out]}

    return _added(arrow_pass(fit, step, "i int, value array<double>"), np.float64)


class Whitening:
    """Count, sums, eigenvalues and eigenvectors of the fit list."""

    def __init__(self, n: int, total: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float, error: float) -> None:
        self.n, self.total, self.values, self.vectors, self.trace, self.error = n, total, values, vectors, trace, error

    @property
    def matrix(self) -> np.ndarray:
        """Whitened vectors are centred ones times this."""
        return self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        whole = x.astype(object) * self.n - self.total.astype(object) if self._wide(x) else x * self.n - self.total
        if whole.dtype != object and float(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < MAX_LONG / 2:
            return (whole * whole).sum(axis=1).tolist()
        sums = (sum(int(y) * int(y) for y in row) for row in whole)
        return [y if y <= MAX_LONG else None for y in sums]

    def _wide(self, x: np.ndarray) -> bool:
        return float(np.abs(x).max(initial=0)) * self.n >= MAX_LONG / 2


def fitted(vectors: DataFrame, top: int = 16) -> Whitening | None:
    """Whitening by the ``top`` components of the distinct vectors ``x``; None without any spread.

    Components whose eigenvalue is below 1e-12 of the trace have no direction and are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    # Equal vectors meet in the partial aggregation of their tasks, so a frequent one costs a row per task.
    fit = scratch.put(vectors.select("x").distinct())
    n, total = _sums(fit)
    if not n:
        return None
    v = covariance(fit, n, total)
    trace = float(np.trace(v))
    values, basis = components(v)
    keep = values[:top] > 1e-12 * trace
    values, basis = values[:top][keep], basis[:, :top][:, keep]
    if not len(values):
        scratch.drop(fit)
        return None
    found = Whitening(n, total, values, basis, trace, 0.0)
    found.error = float(np.abs(covariance(fit, n, total, found.matrix) - np.eye(len(values))).max())
    scratch.drop(fit)
    return found


def whitened(vectors: DataFrame, found: Whitening | None, id_col: str) -> DataFrame:
    """(id, deviation, whitened array<double>) of each row of ``fixed_point``."""
    kind = dict(vectors.dtypes)[id_col]
    packed = share(vectors.sparkSession, found)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        w = shared(packed)
        if w is None:
            return
        turn = w.matrix
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), np.int64)
                yield {"id": batch.column(0), "deviation": w.deviations(x), "whitened": list(_centred(x, w.n, w.total) @ turn)}

    return arrow_pass(
        vectors.select(F.col(f"`{id_col}`").alias("id"), "x"), step, f"id {kind}, deviation long, whitened array<double>"
    )


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 16) -> tuple[DataFrame, Whitening | None]:
    """Whitened vectors of all usable rows, and the fit.

    Rows that repeat, or share an id, each come back; null ids too.  Other columns are left out.  An empty
    table, and one whose vectors are all equal, has no components and gives no rows.
    """
    vectors = fixed_point(df.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")), vector_col)
    found = fitted(vectors, top)
    return whitened(vectors, found, id_col), found


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each usable vector of ``embeddings`` and each of the first 16 components."""
    rows, found = whiten(table(spark, sf, "embeddings"))
    n, trace, error = (found.n, found.trace, found.error) if found else (0, 1.0, 0.0)
    explained = F.array(*[F.lit(float(e) / trace) for e in (found.values if found else [])]).cast("array<double>")
    return rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
