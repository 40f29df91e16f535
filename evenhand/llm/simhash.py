"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Anchors are the words of a perfect product
code on the 64 bits: two Golay [23,12] blocks, a Hamming [15,11] block and a repetition [3,1] block, radius 3+3+1+1 = 8,
2^36 anchors. Every point has one nearest anchor, found by syndrome tables.

Two fingerprints at most t bits apart have a point within r = ceil(t/2) of both; its nearest anchor lies within 8 + r
(at most radius plus threshold) of both. So each distinct fingerprint goes to the nearest anchors of all points within r
of it (about 17 for t = 2), and fingerprints are compared only where they meet at an anchor. No link is lost, and copies of
one fingerprint are one row, so a group of copies costs nothing. Links form components by alternating large-star and
small-star rounds; each round is grouped minima and joins over a shared checkpoint.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and link like any other; fewer words
than a shingle are one shingle; repeated rows share their fingerprint; null ids never name a component unless it has no
other; extra columns are ignored by the search and pass through :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.llm.common import cut, id_key, packed, text_key, unpacked

SHINGLE = 3
MAX_BITS = 2
# Block length, generator polynomial and radius of the perfect cyclic codes (lowest block first).
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1), (3, 0b111, 1))


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text, unsigned. ``bytes.lower`` and ``bytes.split`` know ASCII letters and blanks only."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[lo : lo + (1 << 16) + shingle - 1]
        joined = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [part]
        hashes = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in joined), dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, id, h, fp`` for each row of ``docs`` (fp signed; id and h identify the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column("data")), dtype=np.uint64, count=len(batch))
            yield pa.record_batch([batch.column("doc_id"), batch.column("id"), batch.column("h"), pa.array(prints.view(np.int64))], names=["doc_id", "id", "h", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), id_key(F.col(doc_id)).alias("id"), text_key(F.col(text)).alias("h"), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id bigint, id bigint, h string, fp bigint")


def _remainder(value: int, poly: int) -> int:
    degree = poly.bit_length() - 1
    while value.bit_length() > degree:
        value ^= poly << (value.bit_length() - 1 - degree)
    return value


@cache
def _tables(length: int, poly: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half of a block, and the error that belongs to each syndrome."""
    half = (length + 1) // 2
    low = np.array([_remainder(v, poly) for v in range(1 << half)], dtype=np.int64)
    high = np.array([_remainder(v << half, poly) for v in range(1 << (length - half))], dtype=np.int64)
    errors = np.full(1 << (poly.bit_length() - 1), -1, dtype=np.int64)
    for weight in range(radius + 1):
        for bits in combinations(range(length), weight):
            error = sum(1 << b for b in bits)
            errors[_remainder(error, poly)] = error
    assert (errors >= 0).all(), "not a perfect code"
    return low, high, errors


def nearest_anchor(points: np.ndarray) -> np.ndarray:
    """The code word nearest to each 64-bit point."""
    anchors, shift = np.zeros_like(points), 0
    for length, poly, radius in BLOCKS:
        low, high, errors = _tables(length, poly, radius)
        half = (length + 1) // 2
        block = ((points >> np.uint64(shift)) & np.uint64((1 << length) - 1)).astype(np.int64)
        word = block ^ errors[low[block & ((1 << half) - 1)] ^ high[block >> half]]
        anchors |= word.astype(np.uint64) << np.uint64(shift)
        shift += length
    return anchors


def _replicate(max_bits: int):
    reach = (max_bits + 1) // 2
    flips = np.array([sum(1 << b for b in bits) for w in range(reach + 1) for bits in combinations(range(64), w)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(points), 4096):
                some = points[lo : lo + 4096]
                anchors = np.sort(nearest_anchor(some[:, None] ^ flips[None, :]), axis=1)
                first = np.ones(anchors.shape, dtype=bool)
                first[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                row, _ = np.nonzero(first)
                yield pa.record_batch([pa.array(anchors[first].view(np.int64)), pa.array(some[row].view(np.int64))], names=["anchor", "fp"])

    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``u, v`` (u < v): the pairs of distinct ``fp`` at most ``max_bits`` apart. ``prints`` has each fp once."""
    at = prints.select("fp").mapInArrow(_replicate(max_bits), "anchor bigint, fp bigint")
    left, right = at.select("anchor", F.col("fp").alias("u")), at.select("anchor", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return left.join(right, "anchor").where(near).select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the undirected ``u, v`` edges; root is the component's smallest node."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u != v").distinct())  # u > v throughout
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.toDF("u", "v"))
        edges = cut(small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, id, h, fp, component_id, kept_id, kept_h``: each row's fingerprint, the smallest doc_id it reaches over
    links, and the one document of its component that stays (smallest id, then text key)."""
    rows = cut(fingerprints(docs, shingle, doc_id, text))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("id", "h")).alias("kept")))
    member = components(links(prints, max_bits))
    rooted = prints.join(member, prints["fp"] == member["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("kept").alias("kept"))
    of = rooted.select("fp", "root").join(best, "root").select("fp", "component_id", F.col("kept.id").alias("kept_id"), F.col("kept.h").alias("kept_h"))
    return rows.join(of, "fp").select("doc_id", "id", "h", "fp", "component_id", "kept_id", "kept_h")


def dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each component: its smallest id's. Equal rows count as one."""
    kept = near_groups(docs, shingle, max_bits, doc_id, text).select(F.col("kept_id").alias("id"), F.col("kept_h").alias("h")).distinct()
    rows = packed(docs, doc_id, text).join(kept, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return rows.select(*unpacked(rows, docs.columns))
