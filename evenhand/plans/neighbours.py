"""Exact k nearest neighbours by cutting space into cells.

Each tree (one for each class or group, all in the same jobs) is grown in rounds: every cell of more than ``_CELL_ROWS`` vectors
is cut into up to 2 ** ``_BITS`` cells, by halving the widest axis of a bounded sample of its own vectors, until all fit. So a
cell's size is bounded whatever the data, and the tree is a table with a row for each cell that was cut: points and search balls go
down it by joins on their cell. A vector finds neighbours in its own cell first, which bounds how far they can be; it is done if
that ball ends before the cell does, and is else sent to those other cells the ball reaches. Inside of a cell questions and points
are dealt into blocks of near ones, and a block of questions meets the blocks of points in the order of their distance, until
none is left within its bounds. Only the best k per vector and cell leave a cell. Copies are
collapsed before, so any number of identical rows is one vector with its smallest keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.sources.tables import written

_CELL_ROWS = 8192
_SAMPLE = 16384  # vectors (about) that decide how a cell is cut
_BITS = 8
_BLOCK = 32  # rows of a block inside of a cell, at most
_AT_ONCE = 64  # blocks of questions that are answered together
_SLACK = 1e-9  # bounds are widened by this share: rounding never loses a neighbour

_OFF = "(get(x, get(dims, {n})) - get(cuts, {n}))"
_DOWN = f"""aggregate(sequence(1, depth), named_struct('n', 0, 'm', margin),
    (s, i) -> named_struct('n', 2 * s.n + 1 + cast({_OFF.format(n='s.n')} > 0 AS int), 'm', least(s.m, abs({_OFF.format(n='s.n')}))))"""
_BALL = """transform(aggregate(sequence(1, depth), array(0), (ns, i) -> flatten(transform(ns, n -> filter(array(
    if(get(x, get(dims, n)) - radius <= get(cuts, n), 2 * n + 1, -1), if(get(x, get(dims, n)) + radius > get(cuts, n), 2 * n + 2, -1)), m -> m >= 0)))),
    m -> m - shiftleft(1, depth) + 1)"""


def _cut(sample: np.ndarray, depth: int) -> tuple[list[int], list[float]]:
    """Complete binary tree of axes and cuts in heap order; each level halves the widest axis, with vectors on both sides."""
    dims, cuts, level = [], [], [sample]
    for _ in range(depth):
        below = []
        for part in level:
            dim, cut = 0, 0.0
            if len(part):
                dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                values = np.sort(part[:, dim])
                cut = values[(len(values) - 1) // 2]
                if cut == values[-1]:  # the largest value is met more often than not: it gets a side of its own
                    cut = values[max(np.searchsorted(values, cut) - 1, 0)]
            dims.append(dim)
            cuts.append(float(cut))
            below += [part[part[:, dim] <= cut], part[part[:, dim] > cut]] if len(part) else [part, part]
        level = below
    return dims, cuts


def _grown(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``points`` (``tree, vid, x, ...``, distinct vectors) with their ``cell`` and ``margin``, and the rounds' cuts ``tree, cell, depth, dims,
    cuts``."""
    placed, rounds = points.withColumns({"cell": F.lit(0).cast("bigint"), "margin": F.lit(float("inf"))}), []

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = int(min(_BITS, max(1, np.ceil(np.log2(pdf["n"].iloc[0] / (0.75 * _CELL_ROWS))))))  # cells are not all of one size
        dims, cuts = _cut(np.array(pdf["x"].tolist()), depth)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "depth": [depth], "dims": [dims], "cuts": [cuts]})

    while True:
        large = placed.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > _CELL_ROWS)
        drawn = F.pmod(F.xxhash64("vid", F.lit(len(rounds))), F.col("n")) < _SAMPLE
        some = placed.join(large, ["tree", "cell"]).filter(drawn).select("tree", "cell", "x", "n")
        cuts = written(some.groupBy("tree", "cell").applyInPandas(cut, "tree string, cell bigint, depth int, dims array<int>, cuts array<double>"), "cuts")
        if not cuts.limit(1).count():
            return placed, rounds
        rounds.append(cuts)
        placed = written(_down(placed, cuts), "placed")


def _down(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (``tree, cell, x, margin``) one round down, each in the child its vector lies in, or where it is if its cell was not cut.
    ``margin`` is the distance to the nearest cut."""
    joined = rows.join(cuts, ["tree", "cell"], "left").withColumn("_to", F.expr(_DOWN))
    child = F.col("cell") * (1 << _BITS) + F.col("_to.n") - F.expr("shiftleft(1, depth)") + 2
    moved = {"cell": F.when(F.col("depth").isNull(), F.col("cell")).otherwise(child), "margin": F.coalesce("_to.m", "margin")}
    return joined.select(*[moved[c].alias(c) if c in moved else c for c in rows.columns])


def _reached(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Balls (``tree, cell, x, radius``) one round down: in each child they reach, or where they are if their cell was not cut."""
    joined = rows.join(cuts, ["tree", "cell"], "left")
    below = F.transform(F.expr(_BALL), lambda c: F.col("cell") * (1 << _BITS) + c + 1)
    to = F.explode(F.when(F.col("depth").isNull(), F.array("cell")).otherwise(below))
    return joined.withColumn("_to", to).select(*[F.col("_to").alias(c) if c == "cell" else c for c in rows.columns])


def _blocks(x: np.ndarray) -> np.ndarray:
    """Row numbers in blocks of at most ``_BLOCK`` near rows, all but one of the same size; -1 fills up the others."""
    n, order, ends = len(x), np.arange(len(x)), np.array([0, len(x)])
    while np.diff(ends).max() > _BLOCK:
        sizes, rows = np.diff(ends), x[order]
        part = np.repeat(np.arange(len(sizes)), sizes)
        widest = (np.maximum.reduceat(rows, ends[:-1]) - np.minimum.reduceat(rows, ends[:-1])).argmax(axis=1)
        order = order[np.lexsort((rows[np.arange(n), widest[part]], part))]
        ends = np.sort(np.concatenate([ends, ends[:-1] + sizes // 2]))
    at = ends[:-1, None] + np.arange(np.diff(ends).max())
    return np.where(at < ends[1:, None], order[np.minimum(at, n - 1)], -1)


def _pairs(qx: np.ndarray, limit: np.ndarray, px: np.ndarray, want: int, q_label: np.ndarray | None = None, p_label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``question, point, distance`` of pairs among which are the ``want`` nearest points of every question, with all that tie with the
    last one, as far as they are within its ``limit``. With labels only points of another label than the question's count."""
    q_at, p_at = _blocks(qx), _blocks(px)
    q_fill, p_fill = np.where(q_at < 0, q_at[:, :1], q_at), np.where(p_at < 0, p_at[:, :1], p_at)
    q_low, q_high, p_low, p_high = qx[q_fill].min(1), qx[q_fill].max(1), px[p_fill].min(1), px[p_fill].max(1)
    points = np.where(p_at[:, :, None] < 0, np.nan, px[p_fill])  # no distance to what fills up a block
    found, last = [], np.empty(len(qx))
    for start in range(0, len(q_at), _AT_ONCE):
        here = slice(start, start + _AT_ONCE)
        at, ask = q_at[here], qx[q_fill[here]]
        apart = np.maximum(np.maximum(q_low[here, None] - p_high[None], p_low[None] - q_high[here, None]), 0.0)
        apart = (apart * apart).sum(axis=2) * (1 - _SLACK)
        order = apart.argsort(axis=1, kind="stable")
        apart = np.take_along_axis(apart, order, 1)
        bound = np.where(at < 0, -1.0, (limit[q_fill[here]] * (1 + _SLACK)) ** 2)
        best = np.full((*at.shape, want), np.inf)
        for r in range(len(p_at)):
            busy = np.flatnonzero(apart[:, r] <= bound.max(axis=1))
            if not len(busy):
                break
            leaf = order[busy, r]
            dist = np.zeros((len(busy), at.shape[1], points.shape[1]))
            for j in range(qx.shape[1]):
                diff = ask[busy, :, None, j] - points[leaf][:, None, :, j]
                dist += diff * diff
            if q_label is not None:
                dist[q_label[q_fill[here]][busy][:, :, None] == p_label[p_fill[leaf]][:, None, :]] = np.nan
            b, q = np.nonzero((dist <= bound[busy][:, :, None]).any(axis=2))
            near = dist[b, q]
            if want == 1:
                best[busy[b], q, 0] = np.minimum(best[busy[b], q, 0], np.fmin.reduce(near, axis=1))
            else:
                best[busy[b], q] = np.partition(np.concatenate([best[busy[b], q], near], axis=1), want - 1, axis=1)[:, :want]
            bound[busy[b], q] = np.minimum(bound[busy[b], q], best[busy[b], q].max(axis=1) * (1 + _SLACK))
            i, p = np.nonzero(near <= bound[busy[b], q][:, None])
            found.append((at[busy[b[i]], q[i]], p_at[leaf[b[i]], p], near[i, p]))
        last[at[at >= 0]] = bound[at >= 0]
    q, p, d = (np.concatenate(part) for part in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    kept = d <= last[q]
    return q[kept], p[kept], np.sqrt(d[kept])


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """A column of arrays of doubles as a matrix."""
    return np.asarray(column.combine_chunks().flatten()).reshape(n, -1)


def _labels(q: pa.ChunkedArray, p: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.asarray(pa.chunked_array(q.chunks + p.chunks, q.type).combine_chunks().dictionary_encode().indices)
    return codes[: len(q)], codes[len(q) :]


def _nearest_in_cell(q: pa.Table, p: pa.Table, limit: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The ``want`` nearest keys of every question by distance, then key, as far as ``p`` has them within ``limit``: ``question,
    place, distance, neighbour``, ordered by question and place."""
    lists = p["keys"].combine_chunks()
    if not len(q) or not len(p):
        return np.empty(0, int), np.empty(0, int), np.empty(0), lists.flatten().slice(0, 0)
    labels = _labels(q["label"], p["label"]) if "label" in q.column_names else (None, None)
    row, col, dist = _pairs(_vectors(q["x"], len(q)), limit, _vectors(p["x"], len(p)), want, *labels)
    keys, copies = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    first, each = np.cumsum(copies) - copies, copies[col]
    row, dist = np.repeat(row, each), np.repeat(dist, each)
    key = np.repeat(first[col], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    rank = np.empty(len(keys), np.int64)
    rank[np.asarray(pc.sort_indices(keys))] = np.arange(len(keys))
    order = np.lexsort((rank[key], dist, row))
    row, dist, key = row[order], dist[order], key[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < want
    return row[kept], place[kept], dist[kept], keys.take(pa.array(key[kept]))


def _lists(row: np.ndarray, n: int, dist: np.ndarray, keys: pa.Array) -> pa.Array:
    """For each of ``n`` questions the list of its ``distance, neighbour``."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(dist), keys], ["distance", "neighbour"]))


def _met(questions: DataFrame, points: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(questions, points)`` of every cell; a cell with many questions is answered by several tasks, each with a copy of
    its points."""
    load = questions.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / (4.0 * _CELL_ROWS)).cast("int").alias("parts"))
    asked = questions.join(load, ["tree", "cell"]).withColumn("part", F.pmod(F.hash("qid"), F.col("parts"))).drop("parts")
    copies = points.join(load, ["tree", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    at = ["tree", "cell", "part"]
    return asked.groupBy(*at).cogroup(copies.groupBy(*at)).applyInArrow(answer, schema)


def search(points: DataFrame, questions: DataFrame | None, want: int, key_type: str) -> tuple[DataFrame, DataFrame]:
    """The ``want`` nearest keys of every question (by distance, then key), as two tables ``qid, near`` of sorted lists of ``distance,
    neighbour``: what a question (of a tree) found in its own cell, a row each and written, and what it found in other cells. The
    nearest are among both.

    ``points``: distinct vectors ``tree, vid, x, keys`` with their ``want`` smallest keys; ``questions``: ``tree, qid, x`` (``qid``
    names a vector; it may ask several trees), or ``qid`` alone for some of the points themselves, or None for all of them. If both have a ``label``, only points of another label are found, and a question
    whose own cell has none does not look further."""
    placed, rounds = _grown(points)
    label = [c for c in ("label",) if c in points.columns]
    if questions is None or "x" not in questions.columns:  # points, so they are placed already
        at_home = placed.select("tree", F.col("vid").alias("qid"), "x", *label, "cell", "margin")
        at_home = at_home if questions is None else written(at_home.join(questions, "qid", "left_semi"), "home")
    else:
        at_home = questions.select("tree", "qid", "x", *label, F.lit(0).cast("bigint").alias("cell"), F.lit(float("inf")).alias("margin"))
        for cuts in rounds:
            at_home = _down(at_home, cuts)
        at_home = written(at_home, "home") if rounds else at_home
    placed = placed.select(*[F.col(c).alias(c) for c in ("tree", "cell", "x", "keys", *label)])  # columns of their own: questions may be the same table

    def own(q: pa.Table, p: pa.Table) -> pa.Table:
        row, place, dist, keys = _nearest_in_cell(q, p, np.full(len(q), np.inf), want)
        radius, full = np.full(len(q), np.inf), place == want - 1
        radius[row[full]] = dist[full] * (1 + _SLACK)
        return pa.table([*[q[c] for c in kept], pa.array(radius), _lists(row, len(q), dist, keys)], names=[*kept, "radius", "near"])

    def other(q: pa.Table, p: pa.Table) -> pa.Table:
        row, _, dist, keys = _nearest_in_cell(q, p, np.asarray(q["radius"]), want)
        asked, row = np.unique(row, return_inverse=True)
        return pa.table([q["qid"].take(pa.array(asked)), _lists(row, len(asked), dist, keys)], names=["qid", "near"])

    lists = f"near array<struct<distance: double, neighbour: {key_type}>>"
    kept = ["tree", "qid", "x", *label, "cell", "margin"]
    types = {"x": "array<double>", "cell": "bigint", "margin": "double"}
    mine = _met(at_home, placed, own, ", ".join(f"{c} {types.get(c, 'string')}" for c in kept) + f", radius double, {lists}")
    mine = written(mine, "found")
    balls = mine.filter("radius >= margin" + (" AND radius < double('inf')" if label else "")).select("tree", "qid", "x", *label, F.col("cell").alias("own"), "radius", F.lit(0).cast("bigint").alias("cell"))
    for cuts in rounds:
        balls = _reached(balls, cuts)
    balls = written(balls.filter("cell <> own").drop("own"), "asked")
    return mine.select("qid", "near"), _met(balls, placed, other, f"qid string, {lists}")


def _points(df: DataFrame, tree: Column, key: str, features: Sequence[str]) -> DataFrame:
    """Written rows ``tree, _k, x, vid``; ``vid`` names the vector in its tree."""
    rows = df.select(tree.cast("string").alias("tree"), F.col(key).alias("_k"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    name = F.md5(F.concat_ws("|", F.col("tree"), F.array_join(F.transform("x", lambda v: v.cast("string")), ",")))
    return written(rows.filter(F.col("tree").isNotNull()).withColumn("vid", name), "points")


def _distinct(rows: DataFrame, want: int) -> DataFrame:
    """Written distinct vectors ``tree, vid, x, keys`` of :func:`_points`, with their ``want`` smallest keys."""
    if want == 1:
        vectors = rows.groupBy("tree", "vid", "x").agg(F.min("_k").alias("_k")).select("tree", "vid", "x", F.array_compact(F.array("_k")).alias("keys"))
    else:
        few = rows.withColumn("_r", F.row_number().over(W.partitionBy("tree", "vid").orderBy("_k"))).filter(F.col("_r") <= want)  # limited before the shuffle
        vectors = few.groupBy("tree", "vid").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("_k")).alias("keys"))
    return written(vectors, "vectors")


def nearest(df: DataFrame, key: str, features: Sequence[str], k: int, by: str | None = None, asking: DataFrame | None = None) -> DataFrame:
    """``key, neighbour, distance, rank``: the k nearest other rows (ties by key); with ``by`` among the rows of the same class,
    for all classes at once (rows without a class are left out). ``asking`` (``key``) names the rows whose neighbours are wanted, else
    all are."""
    want, key_type = k + 1, dict(df.dtypes)[key]  # a vector finds itself or a copy first
    rows = _points(df, F.col(by) if by else F.lit(""), key, features)
    asked, points = rows, rows
    if asking is not None:
        asked = written(rows.join(asking.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi"), "asking")
        points = rows.join(asked.select("tree").distinct(), "tree", "left_semi")  # classes that are asked
    some = None if asking is None else asked.select(F.col("vid").alias("qid"))
    own, others = search(_distinct(points, want), some, want, key_type)
    more = others.groupBy("qid").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = F.slice(F.array_sort(F.concat("near", "more")), 1, want)
    lists = own.join(more, "qid", "left").select("qid", F.coalesce(both, "near").alias("near"))
    rest = F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("_k")), 1, k)
    return asked.join(lists, F.col("vid") == F.col("qid")).select(F.col("_k").alias(key), F.posexplode(rest).alias("pos", "s")).select(
        key, F.col("s.neighbour").alias("neighbour"), F.col("s.distance").alias("distance"), (F.col("pos") + 1).alias("rank")
    )


def nearest_in_other_groups(df: DataFrame, key: str, group: str, features: Sequence[str]) -> DataFrame:
    """``key, grp, neighbour, distance``: the nearest record of another group (the smallest key on ties). All groups share a tree;
    a vector that has none of another group in its cell asks the trees of all other groups, one a group, the groups' names come to
    the driver then."""
    rows, key_type = _points(df, F.col(group), key, features), dict(df.dtypes)[key]
    vectors = _distinct(rows, 1)
    shared = vectors.withColumnRenamed("tree", "label").withColumn("tree", F.lit(""))
    own, others = search(shared, None, 1, key_type)
    found = others
    alone = written(own.filter(F.size("near") == 0).select("qid"), "alone")
    names = [r["tree"] for r in vectors.select("tree").distinct().collect()] if alone.limit(1).count() else []
    if len(names) > 1:
        each = F.explode(F.array_remove(F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>"), F.col("own")))
        asked = vectors.join(alone, F.col("vid") == F.col("qid"), "left_semi").select(F.col("tree").alias("own"), F.col("vid").alias("qid"), "x")
        for found_there in search(vectors, asked.select(each.alias("tree"), "qid", "x"), 1, key_type):
            found = found.unionByName(found_there)
    more = found.groupBy("qid").agg(F.min(F.get("near", F.lit(0))).alias("more"))
    best = own.join(more, "qid", "left").select("qid", F.least(F.get("near", F.lit(0)), "more").alias("s")).filter("s IS NOT NULL")
    return rows.join(best, F.col("vid") == F.col("qid")).select(F.col("_k").alias(key), F.col("tree").alias("grp"), F.col("s.neighbour").alias("neighbour"), F.col("s.distance").alias("distance"))
