"""Upper concave hulls of many points per key, without gathering a key's points in one task.

Every piece of the axis gives its own hull; the hulls of neighbouring pieces are merged ``FAN`` at a time until one is left. A
point that is not on its piece's hull is on no larger one, so the result is exact. A hull of whole-number points
keeps far fewer than it was given: at most in the order of n^(2/3) of n, a handful for smooth curves.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evenhand.sources.tables import written

FAN = 32


def chain(xs: Sequence[int], ys: Sequence[int]) -> list[int]:
    """Indices of the vertices of the upper hull of points in rising x; points on an edge are no vertices."""
    kept: list[int] = []
    for i, (x, y) in enumerate(zip(xs, ys)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (xs[b] - xs[a]) * (y - ys[a]) < (ys[b] - ys[a]) * (x - xs[a]):
                break
            kept.pop()
        kept.append(i)
    return kept


def upper_hull(points: DataFrame, key: str, x: str, y: str, pieces: int) -> DataFrame:
    """The points (whole-number ``x``, distinct within a key, and ``y``; ``_piece`` rising or falling with x, below ``pieces``)
    that are vertices of their key's upper hull."""

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        return pdf.iloc[chain(pdf[x].tolist(), pdf[y].tolist())]

    schema = points.schema
    found = points
    while True:
        found = found.groupBy(key, "_piece").applyInPandas(hull, schema)
        if pieces <= 1:
            return found.drop("_piece")
        pieces = -(-pieces // FAN)
        found = written(found.withColumn("_piece", F.floor(F.col("_piece") / FAN).cast("int")).select(*points.columns), "hull")
