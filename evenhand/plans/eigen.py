"""Largest eigenvalues of a sparse symmetric matrix that is a table, by a block Krylov iteration.

The matrix stays a table of cells and the basis a table with one row per index; a step multiplies the newest block by a join and
an aggregation. What comes to the driver are products of basis vectors (a matrix of the basis' width, at most :data:`WIDTH`).
The basis is kept orthogonal, so the projected matrix gives values, vectors and the size of what is left over (the residual)
without another multiplication. When the basis is full it is cut to the best vectors and continued (thick restart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evenhand.functions.hashing import uniform
from evenhand.sources.tables import written

WIDTH = 96  # basis vectors
TOLERANCE = 1e-9  # of a residual, as a share of the largest eigenvalue
ROUNDS = 100  # multiplications


def _products(state: DataFrame, left: list[str], right: str, shape: tuple[int, int]) -> np.ndarray:
    """(left columns side by side)' right over all rows: summed in the tasks, then by place."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(shape)
        for part in parts:
            if len(part):
                out += np.hstack([np.stack(part[c]) for c in left]).T @ np.stack(part[right])
        yield pd.DataFrame({"at": np.arange(out.size), "v": out.ravel()})

    sums = state.select(*dict.fromkeys([*left, right])).mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(shape[0] * shape[1])
    for r in sums.collect():  # the projected matrix
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _combined(state: DataFrame, columns: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """``key, s`` and each named column: the sum of old columns times matrices."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                old = {c: np.stack(part[c]) for terms in columns.values() for c in terms}
                new = {c: list(sum(old[o] @ m for o, m in terms.items())) for c, terms in columns.items()}
                yield pd.DataFrame({"key": part["key"], "s": part["s"], **new})

    return state.mapInPandas(run, "key string, s double, " + ", ".join(f"{c} array<double>" for c in columns))


def _times(cells: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """The matrix times ``x`` of ``key, s, x`` less its part along ``s``: ``key, w``."""
    along = block.agg(*[F.sum(F.col("s") * F.get("x", F.lit(j))).alias(f"a{j}") for j in range(width)]).first()
    x = block.select(F.col("key").alias("b"), "x")
    sums = cells.join(x, "b").groupBy("a").agg(*[F.sum(F.col("v") * F.get("x", F.lit(j))).alias(f"w{j}") for j in range(width)])
    rows = block.select("key", "s").join(sums, F.col("key") == F.col("a"), "left")
    parts = [F.coalesce(F.col(f"w{j}"), F.lit(0.0)) - F.col("s") * F.lit(along[f"a{j}"]) for j in range(width)]
    return rows.select("key", F.array(*parts).alias("w"))


def largest_eigenpairs(cells: DataFrame, keys: DataFrame, dims: int, width: int = WIDTH, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``key, s, x`` (``x``: an entry per found vector), eigenvalues (falling) and residual norms of the matrix ``cells`` (``a, b, v``,
    both triangles, positive semidefinite) less s s' for ``keys`` (``key, s``).

    At most ``dims`` pairs, fewer where the matrix has a lower rank. Residuals above the tolerance tell that ``rounds`` was
    reached first. ``width`` is raised to three blocks if it is smaller; a block has ``dims`` + 4 vectors, so an eigenvalue may
    repeat as often. No keys: no pairs."""
    n = keys.count()
    block = min(dims + 4, n)
    if n == 0 or dims < 1:
        return keys.withColumn("x", F.array().cast("array<double>")), np.zeros(0), np.zeros(0)
    width = max(width, 3 * block)
    start = F.array(*[uniform(F.col("key"), f"k{j}") - 0.5 for j in range(block)])
    new = written(keys.select("key", "s", start.alias("x")), "eigen")
    state = _combined(new, {"q": {"x": np.zeros((block, 0))}})  # no basis vector yet
    new = _times(cells, new, block)
    inner = np.zeros((0, 0))  # Q'AQ of the multiplied part of the basis
    done, scale = 0, 0.0
    for number in range(rounds):
        c, b = inner.shape[0], block
        both = written(state.join(new, "key"), "eigen")
        # twice against the basis, then against itself
        first = _products(both, ["q"], "w", (c, b)) if c else np.zeros((0, b))
        both = written(_combined(both, {"q": {"q": np.eye(c)}, "w": {"w": np.eye(b), "q": -first}}), "eigen") if c else both
        again = _products(both, ["q", "w"] if c else ["w"], "w", (c + b, b))
        second, left = again[:c], again[c:] - again[:c].T @ again[:c]
        size, turn = np.linalg.eigh((left + left.T) / 2)
        if c:  # the product was A times the newest block: columns of Q'AQ
            inner[:, done:] = first + second
            inner[done:, :] = inner[:, done:].T
            values, vectors = np.linalg.eigh((inner + inner.T) / 2)
            values, vectors = values[::-1], vectors[:, ::-1]
            scale = max(scale, values[0])
            part = vectors[done:, :dims]
            residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", part, left, part), 0.0))
        kept = size > max(1e-24, (1e-10 * scale) ** 2) if c else size > 1e-24
        if not kept.any() or number == rounds - 1 or (c and (residual <= tolerance * scale).all() and c >= min(dims, n)):
            break
        root = turn[:, kept] / np.sqrt(size[kept])
        terms = {"q": np.hstack([np.eye(c), -second @ root]), "w": np.hstack([np.zeros((b, c)), root])} if c else {"w": root}
        if c + root.shape[1] + block > width:  # thick restart: the best vectors and the newest block
            best = vectors[:, : dims + 4]
            terms = {"q": np.hstack([best, -second @ root]), "w": np.hstack([np.zeros((b, best.shape[1])), root])}
            inner, c = np.diag(values[: dims + 4]), best.shape[1]
        state = written(_combined(both, {"q": terms}), "eigen")
        done, block = c, root.shape[1]
        inner = np.pad(inner, (0, block))
        at = list(range(c, c + block))
        new = _times(cells, state.select("key", "s", F.array(*[F.get("q", F.lit(j)) for j in at]).alias("x")), block)
    if not inner.shape[0]:
        return keys.withColumn("x", F.array().cast("array<double>")), np.zeros(0), np.zeros(0)
    found = min(dims, int((values > 1e-9 * scale).sum()))
    out = _combined(both, {"x": {"q": vectors[:, :found]}})
    return written(out, "eigen"), values[:found], residual[:found]
