"""Exact quantiles without gathering a column in one task, and quantile binning.

``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a value becomes a 64-bit key of the same
order, and the keys at the wanted ranks are found digit by digit: a pass counts the next ``BITS`` bits of the keys that share
the digits found so far, for all columns and ranks at once. At most four passes over the written keys do for any data (fewer for
short tables): ties, skew and outliers do not raise their number, nor what one of them counts, at most 65,536 rows for a column
and rank. Columns with few distinct values are counted outright. The outcome is a handful of numbers per column, so it is returned as Python
floats, like the fitted state of any Spark ML estimator.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from evenhand.functions.numeric import as_double
from evenhand.sources.tables import written

QUINTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
BITS = 16  # of a digit: four passes, and at most 65,536 counts for a column and rank
_FEW = 64  # up to this estimate the distinct values are counted outright
_MANTISSA = 52


def sketch(col: Column, probs: Sequence[float], accuracy: int) -> Column:
    """Approximate percentiles, with the list of probabilities as one parsed literal."""
    return F.percentile_approx(col, F.expr("array(" + ", ".join(f"{p!r}D" for p in probs) + ")"), accuracy)


def with_order_key(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the double ``value`` as a long of the same order (its IEEE bits, negative for negative numbers); null stays null.

    The exponent comes from a logarithm that is then set right, everything else is exact. The steps are columns, so each is
    computed once a row.
    """
    size, guess, power, exponent = F.abs(F.col(value)), F.col("_guess"), F.col("_power"), F.col("_exponent")
    rows = df.select("*", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int").alias("_guess"))
    rows = rows.select("*", F.pow(F.lit(2.0), guess).alias("_power"))
    step = F.when((size < power) & (guess > -1022), -1).when((size / power >= 2.0) & (guess < 1023), 1).otherwise(0)
    rows = rows.select("*", (guess + step).alias("_exponent"))
    fraction = (size / F.pow(F.lit(2.0), exponent) * float(1 << _MANTISSA)).cast("bigint")
    key = (exponent + 1022).cast("bigint") * F.lit(1 << _MANTISSA) + fraction
    key = F.when(size == 0.0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << _MANTISSA)).otherwise(key)
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], key.alias("_size_key"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_size_key") * F.when(F.col(value) < 0.0, -1).otherwise(1)).alias(out))


def key_value(key: int) -> float:
    """The double of a key of :func:`with_order_key`."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of each column; None for a column without values."""
    return {c: q for c, (q, _) in _quantiles(df, columns, probs).items()}


def bin_edges(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUINTILES, keep_discrete: int = 5
) -> dict[str, list[float] | None]:
    """Distinct quantile edges per column; None where the column stays discrete.

    ``keep_discrete=0`` bins every numeric column, also a 0/1 one (which then collapses to one bin).
    Columns that are not numeric are always discrete.
    """
    numeric = [f.name for f in df.schema.fields if f.name in set(columns) and isinstance(f.dataType, NumericType)]
    found = _quantiles(df, numeric, probs, keep_discrete)
    edges: dict[str, list[float] | None] = {c: None for c in columns}
    return edges | {c: None if q is None or (few is not None and few <= keep_discrete) else sorted(set(q)) for c, (q, few) in found.items()}


def _quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], few_values: int = 0) -> dict[str, tuple[list[float] | None, int | None]]:
    """Quantiles of each column, with its number of distinct values where there are few."""
    cols = list(columns)
    if not cols:
        return {}
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), as_double(F.col(f"`{c}`")).alias("x")) for i, c in enumerate(cols)]))
    keys = written(with_order_key(df.select(cells).filter("x IS NOT NULL"), "x", "k").select("c", "k"), "keys")
    sizes = {r["c"]: r for r in keys.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("k").alias("d")).collect()}  # a row a column
    todo = sorted(sizes)
    places = {i: [p * (sizes[i]["n"] - 1) for p in probs] for i in todo}
    ranks = {i: sorted({r for h in places[i] for r in (floor(h), ceil(h))}) for i in todo}
    few = [i for i in todo if sizes[i]["d"] <= max(_FEW, 2 * few_values)]
    values, distinct = _counted(keys, few, ranks)
    values |= _searched(keys, {i: r["n"] for i, r in sizes.items()}, {i: ranks[i] for i in todo if i not in set(few)})
    out: dict[str, tuple[list[float] | None, int | None]] = {c: (None, None) for c in cols}
    for i in todo:
        q = []
        for h in places[i]:
            lo, hi = key_value(values[(i, floor(h))]), key_value(values[(i, ceil(h))])
            q.append(lo + (hi - lo) * (h - floor(h)))
        out[cols[i]] = (q, distinct.get(i))
    return out


def _counted(keys: DataFrame, few: list[int], ranks: dict[int, list[int]]) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Keys at 0-based ranks, and distinct values, of columns with few values: their value counts are collected."""
    if not few:
        return {}, {}
    counts = keys.filter(F.col("c").isin(few)).groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).orderBy("c", "k").collect()
    found, distinct, upto = {}, dict.fromkeys(few, 0), dict.fromkeys(few, 0)
    for r in counts:
        distinct[r["c"]] += 1
        found |= {(r["c"], i): r["k"] for i in ranks[r["c"]] if upto[r["c"]] <= i < upto[r["c"]] + r["n"]}
        upto[r["c"]] += r["n"]
    return found, distinct


def _searched(keys: DataFrame, sizes: dict[int, int], ranks: dict[int, list[int]]) -> dict[tuple[int, int], int]:
    """Keys at 0-based ranks, a digit a pass. The state between passes is, for each column and rank, the bits found, the rank that
    is left among the keys with these bits, and how many these are; once few enough are left, the last pass takes all bits."""
    state = {(c, r): (0, r, sizes[c]) for c, rs in ranks.items() for r in rs}
    k, done = F.col("k"), 64
    while state and done:
        first = done == 64
        rest = 0 if max(n for _, _, n in state.values()) <= 1 << BITS else done - BITS
        prefixes = {c: sorted({state[(c, r)][0] for r in ranks[c]}) for c in ranks}
        if first:
            inside, prefix, digit = F.col("c").isin(list(prefixes)), F.lit(0).cast("bigint"), F.shiftright(k, rest)
        else:
            prefix, digit = F.shiftright(k, done), F.shiftright(k, rest).bitwiseAND(F.lit((1 << (done - rest)) - 1))
            inside = reduce(Column.__or__, [(F.col("c") == c) & prefix.isin(p) for c, p in prefixes.items()])
        counts = keys.filter(inside).groupBy("c", prefix.alias("prefix"), digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("c", "prefix").orderBy("digit"))  # at most 2 ** BITS digits
        wanted = ", ".join(f"named_struct('c', {c}, 'p', {p}L, 'left', {left}L)" for c, p, left in sorted({(c, p, left) for (c, _), (p, left, _) in state.items()}))
        asked = F.expr(f"filter(array({wanted}), w -> w.c = c AND w.p = prefix AND w.left < upto AND w.left >= upto - n)")
        hits = counts.withColumn("upto", upto).select("c", "prefix", "digit", "n", (F.col("upto") - F.col("n")).alias("below"), F.explode(asked).alias("w"))
        found = {(h["c"], h["prefix"], h["w"]["left"]): h for h in hits.collect()}  # a row for each column and rank
        for at, (known, left, _) in state.items():
            h = found[(at[0], known, left)]
            state[at] = (h["digit"] if first else (known << (done - rest)) | h["digit"], left - h["below"], h["n"])
        done = rest
    return {at: key for at, (key, _, _) in state.items()}


def few_valued(df: DataFrame, columns: Sequence[str], limit: int) -> set[str]:
    """Columns of any type with at most ``limit`` distinct non-null values: a sketch rules out the
    clearly larger ones, the rest are listed exactly (their value sets are small)."""
    cols = list(columns)
    if not cols:
        return set()
    est = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    near = [c for c in cols if est[c] <= max(_FEW, 2 * limit)]
    if not near:
        return set()
    exact = df.agg(*[F.size(F.collect_set(c)).alias(c) for c in near]).first()
    return {c for c in near if exact[c] <= limit}


def bin_index(col: Column, edges: Sequence[float]) -> Column:
    """0-based right-closed bin of a value: the number of inner edges below it."""
    out = F.lit(0)
    for e in list(edges)[1:-1]:
        out = out + F.when(col > F.lit(float(e)), 1).otherwise(0)
    return F.when(col.isNotNull(), out)


def discretise(df: DataFrame, columns: Sequence[str], edges: dict[str, list[float] | None]) -> list[Column]:
    """Each column as a string code: its bin, or the value itself where it stays discrete."""
    cols = []
    for c in columns:
        if edges.get(c) is None:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(bin_index(as_double(F.col(c)), edges[c]).cast("string").alias(c))
    return cols
