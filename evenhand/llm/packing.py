"""Best-fit decreasing packing of token sequences, over the whole table at once.

Documents are tokenized where they lie; only those longer than the capacity are cut, their first piece taking the remainder. What
best-fit decreasing decides depends on lengths alone, and there are at most ``capacity`` of them: the lengths are counted, and
the pack of all pieces is planned from the counts. Pieces of one length follow each other, so bins of equal remaining capacity
are a range of numbers and move together: a segment tree over the remaining capacities finds the tightest that still fits in
logarithmic time, and each bin of the range takes as many as fit before the next one, as they would one by one. A range at least
halves its capacity with each move and a length adds at most three ranges, so the plan has at most 3 x capacity x log2(capacity)
steps whatever the table's size. Pieces are range-sorted by falling length; a piece's place in that order finds its step, and
with it bin and offset.

Ids are those of ``tokenizers`` for the given file. For byte-level BPE files tiktoken's merge loop, fed with the same vocabulary,
gives the same ids four times faster; texts with characters whose class has changed between Unicode versions, and spans
without a break, go to ``tokenizers`` itself.

Defined cases: a null text is empty; an empty text is its end token alone; a null id stays null, repeated rows are packed each;
an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import cut, tasks

CAPACITY = 1024
END = 2
_SPAN = 65_536  # characters encoded at a time
_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")  # byte-level pre-tokens never go over such a blank
_BLOCK = 200_000  # ids of one output batch, where ids are kept


def _stable_characters() -> frozenset[str]:
    """Characters whose class is the same in Unicode 3.2 and now, so that no two libraries' tables differ on them."""
    old = unicodedata.ucd_3_2_0
    return frozenset(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if "Cn" != old.category(c) == unicodedata.category(c))


def _byte_values() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, all other bytes for the characters from U+0100 on, in order."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of texts by the tokenizer file at ``path``, without special tokens added, plus ``end``."""

    def __init__(self, path: str, end: int | None = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.end = [] if end is None else [end]
        self.fast = self._byte_level(path)
        self.stable = _stable_characters() if self.fast else frozenset()
        self.special: set[str] = set()

    def _byte_level(self, path: str):
        """tiktoken's merge loop over the same vocabulary, or None where the file is of another kind."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = {t["content"]: t["id"] for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or len(added) < len(spec["added_tokens"]):
            return None
        value = _byte_values()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        ranks = {bytes(value[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def _spans(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > _SPAN:
            found = _BREAK.search(text, at + _SPAN // 2)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _ids(self, span: str) -> list[int]:
        if self.fast and len(span) <= _SPAN and (span.isascii() or self.stable.issuperset(span)):
            return self.fast.encode(span, allowed_special="all")
        return self.exact.encode(span, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> np.ndarray:
        if not self.fast:  # nothing is known about where such a text may be split
            ids = self._ids(text or "")
        else:
            ids = [i for span in self._spans(text or "") for i in self._ids(span)] if len(text or "") > _SPAN else self._ids(text or "")
        return np.array([*ids, *self.end], dtype="<u4")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int | None = END, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, encoded = Encoder(path, end), None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, value in zip(batch[0], batch[1]):
                encoded = encode(value.as_py())
                cuts = np.arange(len(encoded), 0, -capacity)[::-1] if len(encoded) else np.array([0])
                for k, stop in enumerate(cuts.tolist()):
                    start = int(cuts[k - 1]) if k else 0
                    part = encoded[start:stop]
                    rows.append((key.as_py(), k, start, stop - start, zlib.crc32(part.tobytes()), part if ids else None))
                held += len(encoded) if ids else len(cuts)
                if held > _BLOCK:
                    yield _batch(rows, ids)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, ids)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, schema)


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    keys, pieces, starts, lengths, crcs, parts = zip(*rows)
    out = {"doc_id": pa.array(keys), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
    return pa.RecordBatch.from_pydict(out | ({"ids": pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))} if ids else {}))


class _OpenBins:
    """Ranges of open bins by remaining capacity, with a segment tree over the capacities that have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node //= 2

    def put(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.ranges[capacity].append((first, n))
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.ranges[capacity].pop()

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity of at least ``size``."""
        node = size + self.leaves
        while not self.tree[node]:
            while node & 1:  # a right child: nothing further right below its parent
                node //= 2
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.tree[2 * node])
        return node - self.leaves


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (how many of each length) as steps ``(first, each, bin, offset)``: the pieces from place
    ``first`` on (lengths falling) go, ``each`` to a bin, into the bins from ``bin`` on, behind ``offset`` tokens."""
    bins, steps, place, opened = _OpenBins(capacity), [], 0, 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = bins.tightest(size)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            else:
                first, n = bins.take(room)
            each = room // size
            full = min(n, left // each)
            for many, taken in ((full, each), (min(n - full, 1) if full < n else 0, left - full * each)):
                if many and taken:
                    steps.append((place, taken, first, capacity - room))
                    bins.put(room - taken * size, first, many)
                    place, first, n, left = place + many * taken, first + many, n - many, left - many * taken
                if not left:
                    break
            bins.put(room, first, n)
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (rows with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    rows = cut(pieces)
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # a row a length
    steps = np.array(best_fit(counts, capacity), dtype=np.int64).reshape(-1, 4)
    order = [F.col("length").desc(), F.col("_row")]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()))
    starts, before = {}, 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row a task
        starts[r["_part"]], before = before, before + r["count"]
    shared = rows.sparkSession.sparkContext.broadcast((steps, starts))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, each, bin_, offset), starts = shared.value[0].T, shared.value[1]
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = starts[batch["_part"][0].as_py()] if at is None else at
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            step = np.searchsorted(first, place, side="right") - 1
            nth, size = place - first[step], batch["length"].to_numpy()
            found = {"sequence_id": bin_[step] + nth // each[step], "offset": offset[step] + nth % each[step] * size}
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in columns} | {c: pa.array(v, pa.int64()) for c, v in found.items()})

    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return placed.mapInArrow(task, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences themselves, from packed pieces with ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
