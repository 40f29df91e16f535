"""Embedding whitening by QDWH spectral divide-and-conquer.

Sums and the centred covariance of all vectors are formed in the tasks and added up; what comes to the driver is one matrix of the
vectors' dimension. There the eigenvectors are found by spectral divide-and-conquer: the polar factor of the shifted matrix
(dynamically weighted Halley iteration, each step one QR factorisation) is the matrix sign, which gives the projectors on
the invariant subspaces above and below the shift; each is split again until one dimension, a component, is left. The shift is
the mean eigenvalue, which always lies between the smallest and the largest. Mean, components and scales go out by broadcast,
and each task whitens its own rows.

Entries are taken as integers, floor(scale x entry) + base, so sums and deviations are exact.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out, and so are vectors of another
length than the commonest (the shortest of equally common ones); directions without variance (eigenvalue up to 1e-12 of the
largest) are no components; entries beyond +-2^52 after scaling are held at that bound; a deviation beyond 64 bits is
null; an empty table gives no rows. Ties between eigenvalues give some basis of their subspace, the same for all rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, BASE = 64, 1_000_000
MOST = 32
_ROWS = 4096  # vectors handled at a time
_BOUND = 2.0**52
_FLAT = 1e-12


def _polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix: its matrix sign."""
    n = len(a)
    x, low, eye = a / np.linalg.norm(a), np.finfo(float).eps / n, np.eye(n)
    for _ in range(40):
        low2 = low * low
        gamma = (4 * (1 - low2) / (low2 * low2)) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + gamma)
        u = root + np.sqrt(max(8 - 4 * gamma + 8 * (2 - low2) / (low2 * root), 0.0)) / 2
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(w) * x, eye]))
        new = v / w * x + (u - v / w) / np.sqrt(w) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        change, x = np.linalg.norm(new - x), new
        low = min(low * (u + v * low2) / (1 + w * low2), 1.0)
        if abs(1 - low) < 1e-14 and change < 1e-10 * np.sqrt(n):
            break
    return (3 * x - x @ x @ x) / 2  # one Newton-Schulz step takes the last error off


def _bases(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift near the mean eigenvalue."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * np.finfo(float).eps * max(abs(mean), np.finfo(float).tiny):
        return None
    draws = np.random.default_rng(n)
    for move in (0.0, 0.01, -0.01, 0.1, -0.1, 0.31, -0.31, 0.7, -0.7):
        sign = _polar(a - (mean + move * spread) * np.eye(n))
        above = (np.eye(n) + sign) / 2
        rank = round(float(np.trace(above)))
        if 0 < rank < n and np.linalg.norm(above @ above - above) < 1e-9 * n:
            found = []
            for projector, k in ((above, rank), (np.eye(n) - above, n - rank)):
                basis = np.linalg.qr(projector @ draws.standard_normal((n, k)))[0]
                found.append(np.linalg.qr(projector @ basis)[0])
            return found[0], found[1]
    return None


def components(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; only the first ``most`` if given."""
    a = (a + a.T) / 2
    n = len(a)
    most = n if most is None else min(most, n)
    parts: list[np.ndarray] = []
    found = 0
    todo = [(a, np.eye(n))]  # subspaces in falling order, the highest last
    while todo and found < most:
        block, basis = todo.pop()
        split = _bases(block) if len(block) > 1 else None
        if split is None:  # one dimension, or all directions alike
            parts.append(basis)
            found += basis.shape[1]
            continue
        for part in reversed(split):
            inner = part.T @ block @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    vectors = np.linalg.qr(np.hstack(parts))[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return values[order], vectors


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The batch's vectors as integers."""
    x = np.floor(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(SCALE))
    return np.clip(x, -_BOUND, _BOUND).astype(np.int64) + BASE


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, _ROWS) for k in range(0, batch.num_rows, _ROWS))


def _total(rows: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all vectors of ``of(their matrix)``, formed in the tasks: a partial array each, added up by position."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in _parts(batch):
                value = of(_matrix(part, dim)).ravel()
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})

    sums = rows.select("v").mapInArrow(task, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sums.orderBy("at").collect()])  # one matrix of the vectors' dimension


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors, their sums, the components (columns), their eigenvalues, and the trace of the covariance."""

    dim: int
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact where 64 bits hold it."""
        return (self.n * x - self.sums) if self._fits(x) else self.n * x.astype(object) - self.sums.astype(object)

    def _fits(self, x: np.ndarray) -> bool:
        return self.n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(abs(int(self.sums.min())), abs(int(self.sums.max()))) < 2**62

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, v`` of the vectors to whiten, and their dimension."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = lengths["dim"] if lengths else 0
    return rows.where(F.size("v") == dim), dim


def fit(rows: DataFrame, dim: int, most: int = MOST) -> Whitening:
    """The whitening of ``v`` (all of ``dim`` entries), with up to ``most`` components. Three passes: sums, covariance, and none more."""
    sums = _total(rows, dim, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    if not len(sums):
        return Whitening(dim, 0, np.zeros(dim, dtype=np.int64), np.zeros((dim, 0)), np.zeros(0), 0.0)
    n, sums = int(sums[-1]), sums[:-1]
    centre = Whitening(dim, n, sums, np.eye(dim), np.ones(dim), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        y = centre.whiten(x)  # centred only
        return y.T @ y

    covariance = _total(rows, dim, products, "double").reshape(dim, dim) / n
    values, vectors = components(covariance, most)
    kept = values > _FLAT * max(float(values[0]), 0.0)
    return Whitening(dim, n, sums, vectors[:, kept], values[kept], float(np.trace(covariance)))


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(fitted.values)
    if not k:
        return 0.0
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    mean = _total(rows, fitted.dim, lambda x: shared.value.whiten(x).sum(axis=0), "double") / fitted.n

    def products(x: np.ndarray) -> np.ndarray:
        y = shared.value.whiten(x) - mean
        return y.T @ y

    covariance = _total(rows, fitted.dim, products, "double").reshape(k, k) / fitted.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """``vec_id, deviation`` (sum of squares of n x - sums) and ``whitened``, an array of the components' values."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    dim = fitted.dim

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                x, by = _matrix(part, dim), shared.value
                d = by.deviations(x)
                if d.dtype == object or np.abs(d).max() >= (2**62 / dim) ** 0.5:
                    squares = [int(s) if s < 2**63 else None for s in (d.astype(object) ** 2).sum(axis=1)]
                else:
                    squares = (d * d).sum(axis=1).tolist()
                yield pa.RecordBatch.from_pydict({"vec_id": part["vec_id"], "deviation": pa.array(squares, pa.int64()), "whitened": pa.array(list(by.whiten(x)), pa.list_(pa.float64()))})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"vec_id {kind}, deviation long, whitened array<double>")


def whitened_components(table: DataFrame, most: int = MOST, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component: ``vec_id, component`` (from 1)``, n, deviation, whitened, explained, identity_error``."""
    rows, dim = usable(table, vec_id, embedding)
    fitted = fit(rows, dim, most)
    error = identity_error(rows, fitted)
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    long = whiten(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
