"""Running aggregates along an ordered value, without sorting a whole group in one task.

A window ordered by a score puts a complete group into one task. Here the value axis is cut
into many pieces (any increasing cut points give the exact result; a sketch only balances
them), each piece is aggregated and sorted on its own, and the small table of piece totals
supplies what comes before and after each piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.plans.quantiles import sketch
from evenhand.sources.tables import written

PIECE_ROWS = 100_000
MOST_PIECES = 65_536


def cut_points(table: DataFrame, value: str) -> list[float]:
    """Increasing cut points of a written table's column from a bounded sketch: a piece for every
    ``PIECE_ROWS`` rows (at most ``MOST_PIECES``, as they come to the driver), so one piece of a short table."""
    pieces = min(-(-table.count() // PIECE_ROWS), MOST_PIECES)
    if pieces <= 1:
        return []
    probs = [i / pieces for i in range(1, pieces)]
    found = table.agg(sketch(F.col(value), probs, max(10000, 10 * pieces)).alias("q")).first()["q"]
    return sorted(set(found or []))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``out``: 1-based place of a row within its key by ``order`` (which tells rows apart). The rows are range-sorted
    into pieces, each piece counts its own rows and starts from the pieces before, so a large key is many pieces."""
    k = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(df.repartitionByRange(n, *k, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    ahead = W.partitionBy(*k).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)  # at most a row per piece
    starts = pieces.groupBy(*k, "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias("_k" + c) for c in k], F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start")
    )
    inside = pieces.withColumn("_in", F.row_number().over(W.partitionBy(*k, "_piece").orderBy(*order)))
    match = [inside[c].eqNullSafe(starts["_k" + c]) for c in k] + [inside["_piece"] == starts["_p"]]
    return inside.join(starts, match).select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


def add_piece(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """``_piece``: index of the slice of the axis a value falls into (binary search in the JVM)."""
    if not cuts:
        return df.withColumn("_piece", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_p").transform(df).withColumn(
        "_piece", F.col("_p").cast("int")
    ).drop("_p")


def running_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows (keys, value unique per key, sums, _piece) with inclusive running sums ``run_<s>``.

    Needs ``_piece`` from :func:`add_piece`. Adds ``next_value``, the following value of the key.
    """
    k = list(keys)
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    edge = F.max(value) if descending else F.min(value)
    totals = df.groupBy(*k, "_piece").agg(*[F.sum(s).alias("_t_" + s) for s in sums], edge.alias("_edge"))
    wt = W.partitionBy(*k).orderBy(order("_piece"))
    before = totals.select(
        *k,
        "_piece",
        *[
            F.coalesce(F.sum("_t_" + s).over(wt.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b_" + s)
            for s in sums
        ],
        F.lead("_edge").over(wt).alias("_next"),
    )
    wp = W.partitionBy(*k, "_piece").orderBy(order(value))
    inside = df.select(
        *df.columns,
        *[F.sum(s).over(wp.rowsBetween(W.unboundedPreceding, 0)).alias("_i_" + s) for s in sums],
        F.lead(value).over(wp).alias("_lead"),
    )
    joined = inside.join(before, [*k, "_piece"])
    return joined.select(
        *df.columns,
        *[(F.col("_i_" + s) + F.col("_b_" + s)).alias("run_" + s) for s in sums],
        F.coalesce("_lead", "_next").alias("next_value"),
    )


def running_min_above(df: DataFrame, keys: Sequence[str], value: str, target: str) -> DataFrame:
    """Rows (keys, value unique per key, target) plus ``best_above``: the smallest target at a
    strictly larger value of the same key. Needs ``_piece``."""
    k = list(keys)
    totals = df.groupBy(*k, "_piece").agg(F.min(target).alias("_t"))
    wt = W.partitionBy(*k).orderBy(F.col("_piece").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*k, "_piece", F.min("_t").over(wt).alias("_b"))
    wp = W.partitionBy(*k, "_piece").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    inside = df.withColumn("_i", F.min(target).over(wp))
    return inside.join(before, [*k, "_piece"]).select(*df.columns, F.least("_i", "_b").alias("best_above"))


def first_by_hash(df: DataFrame, key: str, stratum: str, want: Callable[[Column], Column], salt: str) -> DataFrame:
    """``_first``: whether a row is among the first ``want(n)`` of its stratum's n rows in md5 order.

    Sorting a stratum would put half the table in one task. Instead hash prefixes are counted
    (65536 pieces), the piece that holds the cut is found, and only that piece is ranked; every
    other row is decided by comparing its hash with the cut. Rows of one key are told apart by their
    other columns; rows equal in all columns stay together.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit("-" + salt)))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.col(stratum).alias("_y"), F.col(key).alias("_k"), tie.alias("_tie"), h.alias("_h"), F.substring(h, 1, 4).alias("_piece"))
    counts = rows.groupBy("_y", "_piece").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("_y")
    run = counts.withColumn("_upto", F.sum("n").over(w.orderBy("_piece").rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_want", want(F.sum("n").over(w))
    )
    piece = run.filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("n") < F.col("_want"))).select(
        "_y", "_piece", (F.col("_want") - F.col("_upto") + F.col("n")).alias("_left")
    )
    inside = rows.join(piece, ["_y", "_piece"])
    ranked = inside.withColumn("_rank", F.row_number().over(W.partitionBy("_y").orderBy("_h", "_k", "_tie")))
    cut = ranked.filter(F.col("_rank") == F.col("_left")).select("_y", F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"), F.col("_tie").alias("t")).alias("_cut"))
    joined = df.join(cut, F.col(stratum) == F.col("_y"), "left")
    first = F.struct(h.alias("h"), F.col(key).alias("k"), tie.alias("t")) <= F.col("_cut")
    return joined.select(*df.columns, F.coalesce(first, F.lit(False)).alias("_first"))
