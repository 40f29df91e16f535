"""Conversation prefix trie from sorted conversations: member intervals by range-minimum search, without any stack.

Conversations are sorted by their turns (a 128-bit key for each turn, so texts are not shuffled). Neighbours' longest common
prefixes (LCPs, in turns) say where a node ends: the members of the depth-d node through position i are the positions that
reach i over LCPs of at least d. Each candidate prefix (position, depth) finds its left and its right extent on its own, by
binary search in a sparse table of range minima. The sort makes range pieces of bounded size, each with a sparse table of
its own; a search that leaves its piece goes on in one over the pieces (boundary LCP and inner minimum of each) and ends in
a staircase of the piece it stops in: the falling minima of that piece's LCPs from its first or last position. A piece gives
a row with its staircases, at most one step for each depth; these rows come to the driver and go out to all tasks.

Figures of a node are differences of prefix sums over its interval: an LCP of l between neighbours shares the first l turns.

Defined cases: a null role or text is empty; rows without an id are left out; turns of one conversation are ordered by turn
(null first), equal turns by their content; a conversation is one row of 24 bytes a turn; an empty table has no nodes. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import cut, tasks

KEY = 16  # bytes of a turn's key
PIECE_TURNS = 250_000  # turns a sorted piece holds on average
_CHUNK = 512  # ids in one row of an id list that goes over several pieces
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_leaves long, saved_tokens long, ends_sha256 string, run binary"


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as ``(key, bytes)`` of role and text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)))
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("turn"), key.alias("key"), F.octet_length(text_).cast("bigint").alias("bytes")).alias("t")
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def branched(seqs: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c rebuilt as a branch of c - c % every: the first h turns of that one, h = crc32(decimal c) % heads, then
    c's own turns after its first h."""
    c = F.col("conv_id")
    own = seqs.select("conv_id", "turns", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).cast("int").alias("h"))
    first = seqs.where(c % every == 0).select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: row k holds the minima of all windows of 2**k values."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    return table


def _range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum over each [lo, hi]."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), dtype=table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << int(k)) + 1])
    return out


def _next_below(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First index from ``start`` on with a value below ``depth``, by binary search; the length where there is none."""
    at, n = start.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) <= n
        at = np.where(fits & (table[k][np.where(fits, at, 0)] >= depth), at + (1 << k), at)
    return at


def _last_below(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Last index up to ``start`` with a value below ``depth``; -1 where there is none."""
    at = start.copy()
    for k in range(len(table) - 1, -1, -1):
        low = at - (1 << k) + 1
        at = np.where((low >= 0) & (table[k][np.maximum(low, 0)] >= depth), low - 1, at)
    return at


def _common(a: bytes, b: bytes) -> int:
    """Turns two key sequences share from their start."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    return next(k for k in range(n) if a[k * KEY : (k + 1) * KEY] != b[k * KEY : (k + 1) * KEY])


class _Piece:
    """One sorted piece as arrays: ids, lengths, LCPs with the neighbours, running sums."""

    def __init__(self, batches: list[pa.RecordBatch], edges: dict[int, tuple[int, int, int]]):
        table = pa.Table.from_batches(batches)
        self.number = table["piece"][0].as_py()
        before, after, next_length = edges[self.number]
        self.ids = table["conv_id"].to_numpy()
        self.keys = keys = table["key"].to_pylist()
        self.n = len(keys)
        self.length = np.array([len(k) // KEY for k in keys], dtype=np.int64)
        self.lcp = np.array([before, *map(_common, keys, keys[1:])], dtype=np.int64)
        self.ahead = np.append(self.lcp[1:], after)
        sizes = table["sizes"].combine_chunks()
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.sums = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
        self.shared = np.cumsum(self.bytes_to(np.arange(self.n), np.maximum(self.lcp, 0)))
        self.leaves = np.cumsum((self.ahead < self.length).astype(np.int64))
        self.goes_on = bool(after == self.length[-1] == next_length)  # the last sequence is the next piece's first, too

    def bytes_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bytes of the texts of the first ``depth`` turns."""
        return self.sums[self.offsets[row] + depth] - self.sums[self.offsets[row]]

    def summary(self) -> dict:
        """What searches from other pieces need: sums, minima, and the staircases from both ends."""
        least, last = np.minimum.accumulate(self.ids), self.n - 1
        right = self.lcp[1:]
        falls = np.flatnonzero(np.concatenate([[True], right[1:] < np.minimum.accumulate(right)[:-1]])) if last else np.array([], dtype=int)
        stops = np.append(falls, last)  # a search for a depth over right[falls[t]] stops at position falls[t]
        back = right[::-1]
        steps = np.flatnonzero(np.concatenate([[True], back[1:] < np.minimum.accumulate(back)[:-1]])) if last else np.array([], dtype=int)
        starts = np.append(last - steps, 0)
        least_back = np.minimum.accumulate(self.ids[::-1])[::-1]
        return {
            "piece": [self.number], "n": [self.n], "inner": [int(right.min()) if last else 2**62], "shared": [int(self.shared[-1])], "leaves": [int(self.leaves[-1])],
            "least": [int(least[-1])], "right_lcp": [right[falls].tolist()], "right_at": [stops.tolist()], "right_shared": [self.shared[stops].tolist()],
            "right_leaves": [self.leaves[stops].tolist()], "right_least": [least[stops].tolist()],
            "left_lcp": [back[steps].tolist()], "left_least": [least_back[starts].tolist()],
        }


_SUMMARY = (
    "piece long, n long, inner long, shared long, leaves long, least long, right_lcp array<long>, right_at array<long>, right_shared array<long>, "
    "right_leaves array<long>, right_least array<long>, left_lcp array<long>, left_least array<long>"
)


def _summary_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _SUMMARY.split(", "))])


class _Pieces:
    """All pieces' summaries in order, with the sparse tables over them."""

    def __init__(self, rows: list, edges: dict[int, tuple[int, int, int]]):
        self.rows = rows
        self.index = {r["piece"]: k for k, r in enumerate(rows)}
        ahead = lambda name: np.concatenate([[0], np.cumsum([r[name] for r in rows])])
        self.start, self.shared, self.leaves = ahead("n"), ahead("shared"), ahead("leaves")
        self.walls = _minima(np.array([v for r in rows for v in (edges[r["piece"]][0], r["inner"])], dtype=np.int64))
        self.least = _minima(np.array([r["least"] for r in rows], dtype=np.int64))

    def _between(self, lo: int, hi: int) -> int:
        """Smallest id of the pieces lo to hi."""
        return int(_range_min(self.least, np.array([lo]), np.array([hi]))[0]) if lo <= hi else 2**63 - 1

    def right(self, p: int, depth: int) -> tuple[int, int, int, int]:
        """Where the run of ``depth`` that leaves piece p to the right ends: position, sums up to it, smallest id from p + 1 on."""
        q = (int(_next_below(self.walls, np.array([2 * p + 2]), np.array([depth]))[0]) - 1) // 2
        row, t = self.rows[q], _step(self.rows[q]["right_lcp"], depth)
        return (
            int(self.start[q]) + row["right_at"][t], int(self.shared[q]) + row["right_shared"][t], int(self.leaves[q]) + row["right_leaves"][t],
            min(self._between(p + 1, q - 1), row["right_least"][t]),
        )

    def left(self, p: int, depth: int) -> int:
        """Smallest id of the run of ``depth`` that leaves piece p to the left, before p."""
        q = int(_last_below(self.walls, np.array([2 * p - 1]), np.array([depth]))[0]) // 2
        row = self.rows[q]
        return min(self._between(q + 1, p - 1), row["left_least"][_step(row["left_lcp"], depth)])


def _step(falling: list[int], depth: int) -> int:
    """Index of the first value below ``depth``; the length where there is none."""
    return int(np.searchsorted(-np.array(falling, dtype=np.int64), -depth, side="right"))


def _nodes(piece: _Piece, pieces: _Pieces) -> Iterator[pa.RecordBatch]:
    """The nodes whose first member lies in the piece, by a search for each of its candidate prefixes (position, depth)."""
    p, n = pieces.index[piece.number], piece.n
    start = int(pieces.start[p])
    table, least = _minima(piece.lcp), _minima(piece.ids)
    counts = piece.length + 1
    ids = piece.ids.astype(str)
    for lo, hi in _slices(counts, 500_000):
        row = np.repeat(np.arange(lo, hi), counts[lo:hi])
        depth = np.arange(len(row)) - np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi])
        after = _next_below(table, row + 1, depth)
        first = _last_below(table, row, depth)
        smallest = _range_min(least, np.maximum(first, 0), after - 1)
        right, shared, leaves = start + after - 1, pieces.shared[p] + piece.shared[after - 1], pieces.leaves[p] + piece.leaves[after - 1]
        out = np.flatnonzero((after == n) & (depth <= piece.ahead[-1]))  # goes on in the next piece, alike for all of a depth
        if len(out):
            depths, which = np.unique(depth[out], return_inverse=True)
            far = np.array([pieces.right(p, int(d)) for d in depths])[which]
            right[out], shared[out], leaves[out], smallest[out] = far[:, 0], far[:, 1], far[:, 2], np.minimum(smallest[out], far[:, 3])
        out = np.flatnonzero(first < 0)
        if len(out):
            depths, which = np.unique(depth[out], return_inverse=True)
            smallest[out] = np.minimum(smallest[out], np.array([pieces.left(p, int(d)) for d in depths])[which])
        parent = np.concatenate([[0], smallest[:-1]])  # the candidate before is the same position's, one turn less
        own = np.flatnonzero(first == row)  # a node is stated by its first member
        row, depth, right, parent = row[own], depth[own], right[own], parent[own]
        others = right - (start + row)
        saved = shared[own] - (pieces.shared[p] + piece.shared[row]) - others * piece.bytes_to(row, np.maximum(depth - 1, 0))
        inside = leaves[own] - (pieces.leaves[p] + piece.leaves[row] - (piece.ahead[row] < piece.length[row]))
        digests, open_run = [], []
        for i, d in zip(row.tolist(), depth.tolist()):
            stop = i
            while stop < n and piece.length[stop] == d and (stop == i or piece.lcp[stop] == d):
                stop += 1
            split = stop == n and stop > i and piece.goes_on
            digests.append(None if split else hashlib.sha256(",".join(ids[i:stop]).encode()).hexdigest())
            open_run.append(piece.keys[i] if split else None)
        yield pa.RecordBatch.from_pydict({
            "conv_id": smallest[own], "depth": depth, "parent_conv_id": pa.array(parent, mask=depth == 0), "n_convs": others + 1, "n_leaves": inside,
            "saved_tokens": saved, "ends_sha256": pa.array(digests, pa.string()), "run": pa.array(open_run, pa.binary()),
        })


def _slices(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` candidates."""
    group = np.cumsum(counts) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
    return zip(cuts[:-1], cuts[1:])


def _open_ends(piece: _Piece) -> Iterator[pa.RecordBatch]:
    """The ids of each sequence that equals its neighbour's in the piece before or after, in order, as short texts."""
    same = piece.lcp == piece.length  # equal to the sequence before
    breaks = np.flatnonzero(~same)
    spans = [(0, int(breaks[0]) if len(breaks) else piece.n)] if same[0] else []
    if piece.goes_on and len(breaks):
        spans.append((int(breaks[-1]), piece.n))
    for lo, hi in spans:
        ids = piece.ids[lo:hi].astype(str)
        texts = [",".join(ids[k : k + _CHUNK]) for k in range(0, len(ids), _CHUNK)]
        yield pa.RecordBatch.from_pydict({"run": pa.array([piece.keys[lo]] * len(texts), pa.binary()), "piece": pa.array([piece.number] * len(texts), pa.int32()), "part": pa.array(range(len(texts)), pa.int32()), "ids": texts})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run, sha``: the digest of each run's texts, fed one at a time in their order."""
    run, digest = None, None
    for batch in batches:
        for key, ids in zip(batch["run"].to_pylist(), batch["ids"].to_pylist()):
            if key == run:
                digest.update(b",")
            else:
                if digest:
                    yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.binary()), "sha": [digest.hexdigest()]})
                run, digest = key, hashlib.sha256()
            digest.update(ids.encode())
    if digest:
        yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.binary()), "sha": [digest.hexdigest()]})


def _sorted_pieces(seqs: DataFrame, n_turns: int) -> DataFrame:
    """Conversations as ``conv_id, key, sizes, piece``, sorted over all pieces."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    rows = seqs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    n = max(tasks(seqs), n_turns // PIECE_TURNS)
    return cut(rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("piece", F.spark_partition_id()))


def trie(seqs: DataFrame, n_turns: int = 0) -> DataFrame:
    """The nodes of the trie over ``conv_id, turns`` rows (:func:`sequences`): ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` (bytes of shared turns in the subtree) and ``ends_sha256`` (of
    the ids that end here). ``n_turns``, about the number of turns, sets the number of sorted pieces; the result is the same."""
    rows = _sorted_pieces(seqs, n_turns)
    bounds = rows.groupBy("piece").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("piece").collect()  # a row a piece
    walls = [-1, *[_common(bytes(a["last"]), bytes(b["first"])) for a, b in zip(bounds, bounds[1:])], -1]
    lengths = [*[len(b["first"]) // KEY for b in bounds[1:]], -1]
    edges = {b["piece"]: (walls[k], walls[k + 1], lengths[k]) for k, b in enumerate(bounds)}

    def each(do):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                yield from do(_Piece(held, edges))

        return task

    summaries = rows.mapInArrow(each(lambda piece: iter([pa.RecordBatch.from_pydict(piece.summary(), schema=_summary_schema())])), _SUMMARY).orderBy("piece").collect()
    shared = rows.sparkSession.sparkContext.broadcast(_Pieces(summaries, edges))  # a row a piece
    nodes = cut(rows.mapInArrow(each(lambda piece: _nodes(piece, shared.value)), _NODES))
    children = nodes.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    digests = (
        rows.mapInArrow(each(_open_ends), "run binary, piece int, part int, ids string")
        .repartition("run").sortWithinPartitions("run", "piece", "part").mapInArrow(_hashed, "run binary, sha string")
    )
    return nodes.join(children, ["conv_id", "depth"], "left").join(digests, "run", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", "sha").alias("ends_sha256"),
    )
