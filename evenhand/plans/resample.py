"""Bootstrap over counted cells: each row's Poisson(1) weight, drawn for all rows of a cell at once.

Rows of one cell are alike, so the sum of their Poisson(1) weights is all that a statistic of counts needs, and that sum is
one Poisson(n) draw. A replicate costs a hash a cell, however many rows the cell has, and no row is copied. The draws
come from md5 of the cell's name, the replicate and the seed: recomputed tasks and other SQL engines draw the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.functions.numeric import level3

#: Counts below this are drawn from the exact distribution, others by the expansion around the normal one, whose
#: quantiles are within a few hundredths of a row there.
EXACT_BELOW = 32
_RANGE = 16777216.0  # 6 hex digits


def cumulative(mean: int) -> list[float]:
    """Poisson probabilities of at most 0, 1, 2, ... up to where a 24-bit random number can't tell them from 1."""
    term, total, out = exp(-mean), 0.0, []
    while total < 1 - 1 / (4 * _RANGE):
        total += term
        out.append(round(total, 10))
        term *= mean / len(out)
    return out


def _table() -> str:
    rows = ("array(" + ", ".join(f"{c!r}D" for c in cumulative(m)) + ")" for m in range(1, EXACT_BELOW))
    return "array(" + ", ".join(rows) + ")"


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 6), 16, 10).cast("double")


def resampled(cells: DataFrame, names: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """``cells`` (a count ``n`` for each combination of ``names``) once for each ``replicate`` from 1, ``n`` redrawn."""
    tag = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in names], F.col("replicate").cast("string"), F.lit(str(seed)))
    spread = cells.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_h", F.md5(tag))
    u, v, n = (_number(F.col("_h"), 1) + 0.5) / _RANGE, _number(F.col("_h"), 7) / _RANGE, F.col("n").cast("double")
    spread = spread.withColumn("_u", u).withColumn("_z", F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v))
    few = F.size(F.filter(F.try_element_at(F.expr(_table()), F.col("n").cast("int")), lambda c: F.col("_u") >= c))
    many = F.floor(n + F.sqrt(n) * F.col("_z") + (F.col("_z") * F.col("_z") - 1) / 6 + 0.5)
    drawn = F.when(F.col("n") <= 0, F.lit(0)).when(F.col("n") < EXACT_BELOW, few).otherwise(F.greatest(many, F.lit(0)))
    return spread.withColumn("n", drawn.cast("bigint")).drop("_h", "_u", "_z")


def reliability(width: Column) -> Column:
    """HIGH, MEDIUM or LOW by the width of an interval."""
    return level3(width, [("HIGH", 0.1), ("MEDIUM", 0.2)], "LOW")


def intervals(draws: DataFrame, point: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``point`` with the 95% interval of the replicates' values (null where no replicate has one)."""
    ci = draws.groupBy(*keys).agg(F.percentile(value, [0.025, 0.975]).alias("_q"))
    renamed = ci.select(*[F.col(k).alias("_" + k) for k in keys], "_q")
    joined = point.join(renamed, [point[k].eqNullSafe(renamed["_" + k]) for k in keys], "left")
    low, high = F.col("_q")[0], F.col("_q")[1]
    return joined.select(
        *[point[c] for c in point.columns if c != value], F.round(point[value], 4).alias("point"), F.round(low, 4).alias("ci_lower"),
        F.round(high, 4).alias("ci_upper"), F.round(high - low, 4).alias("ci_width"), (high - low).alias("_width"),
    )
