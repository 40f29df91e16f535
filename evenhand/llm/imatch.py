"""Document fingerprints by randomised I-Match.

1. Document frequencies of all words over all documents (counted per task, then added up by word hash).
2. The lexicon: words whose share of documents lies in a band [low, high], that is, in a band of inverse document
   frequency. At most (mean distinct words of a document) / low words can be in it, whatever the corpus size; this is what
   every task gets (8 bytes a word).
3. A text's fingerprint: its distinct words in the lexicon, sorted by hash; the whole list and ``4 * 16`` random subsets
   of the lexicon (each word is in with probability 1/16, 1/64, 1/256 or 1/1024) give a 16-bit hash each, four hex digits.
   Dense subsets tell small changes, thin ones keep agreeing when much of a long text has changed.

The likeness of two fingerprints is the share of subsets with equal hashes among those that are not empty on both sides.

Defined cases: null is an empty text; a text without lexicon words uses all of its words; a text without words has the
all-zero fingerprint, which is like itself only; equal texts have equal fingerprints; repeated rows are equal texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm.common import LOWER, NO_ID, UPPER, cut, id_key, tasks, text_key

LOW, HIGH = 0.0005, 0.5
THRESHOLDS = (4096, 1024, 256, 64)  # of 65,536: the chance that a subset has a word
PER_LEVEL = 16  # four 16-bit draws from each mixed hash
DIGITS = 4 * (1 + PER_LEVEL * len(THRESHOLDS))
MOST_WORDS = 8_000_000  # 64 MB; the bound above with low = 0.0005 stays below unless documents average 4,000 distinct words
_WORD_BYTES = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b) in LOWER + "0123456789" else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and non-ASCII, as UTF-8."""
    return text.encode().translate(_WORD_BYTES).split()


def _hashes(terms) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(t) for t in terms), dtype=np.uint64, count=len(terms))


def document_frequencies(docs: DataFrame, text: str = "text", most: int = 1 << 18) -> DataFrame:
    """``term, df``: in how many documents the words with hash ``term`` occur. A task holds at most about ``most`` words at once."""

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(_hashes(counts.keys()).view(np.int64)), pa.array(np.fromiter(counts.values(), dtype=np.int64))], names=["term", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                counts.update(set((t.as_py() or b"").translate(_WORD_BYTES).split()))
                if len(counts) > most:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    parts = docs.select(F.col(text).cast("binary")).mapInArrow(run, "term bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text: str = "text", most: int = MOST_WORDS) -> np.ndarray:
    """Sorted hashes of the words in the band; at least two documents have each."""
    n = docs.count()
    band = cut(document_frequencies(docs, text).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("term"))
    if band.count() > most:
        raise ValueError(f"over {most} words in the band: raise its lower end")
    return np.sort(band.toArrow().column(0).to_numpy().view(np.uint64))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, lexicon: np.ndarray) -> np.ndarray:
    """The subset hashes, uint16; zero is an empty subset."""
    from xxhash import xxh32_intdigest

    out = np.zeros(1 + PER_LEVEL * len(THRESHOLDS), dtype=np.uint16)
    terms = set(words(text))
    if not terms:
        return out
    every = np.sort(_hashes(terms))
    at = np.searchsorted(lexicon, every)
    kept = every[(at < len(lexicon)) & (lexicon[np.minimum(at, len(lexicon) - 1)] == every)] if len(lexicon) else every[:0]
    kept = kept if len(kept) else every
    out[0] = xxh32_intdigest(kept.tobytes()) % 65535 + 1
    for level, threshold in enumerate(THRESHOLDS):
        draws = [_mix(kept, 4 * level + i).view(np.uint16).reshape(-1, 4) for i in range(PER_LEVEL // 4)]
        inside = np.hstack(draws) < threshold
        for j in np.flatnonzero(inside.any(axis=0)):
            out[1 + level * PER_LEVEL + j] = xxh32_intdigest(kept[inside[:, j]].tobytes()) % 65535 + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    told = (a != 0) | (b != 0)
    return float((a == b)[told].mean()) if told.any() else 1.0


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def from_text(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), dtype=">u2").astype(np.uint16)


def _shared(spark: SparkSession, terms: np.ndarray):
    return spark.sparkContext.broadcast(terms)


def fingerprints(docs: DataFrame, terms: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in the column ``name``."""
    known = _shared(docs.sparkSession, terms)

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(fingerprint(t if isinstance(t, str) else "", known.value)))

    return docs.withColumn(name, prints(F.col(text)))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_following(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``piece, tail, doc_id, id, h, text``: documents dealt into pieces of descending id, each followed by the first rows of
    the next piece (``tail``), so that neighbours meet without a global sort. The last piece is followed by the first row.

    Bounds are at most as many ids as there are shuffle partitions."""
    n = tasks(docs)
    ids = docs.select(id_key(F.col(doc_id)).alias("id"))
    sketch = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("at"), F.max("id").alias("top"), F.min("id").alias("low")).first()
    top = NO_ID if sketch["top"] is None else sketch["top"]
    bounds = np.array(sorted(set(sketch["at"] or []) - {top}), dtype=np.int64)  # the largest id of each piece but the first

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        ids = keys.to_numpy(dtype=np.int64)
        piece = len(bounds) - np.searchsorted(bounds, ids)  # 0: above all bounds
        tail = np.where(np.isin(ids, bounds), piece - 1, np.where(ids == top, len(bounds), -1))
        return pd.Series([[2 * p] if t < 0 else [2 * p, 2 * t + 1] for p, t in zip(piece.tolist(), tail.tolist())])

    rows = docs.select(F.col(doc_id).alias("doc_id"), id_key(F.col(doc_id)).alias("id"), text_key(F.col(text)).alias("h"), F.col(text).alias("text"))
    rows = rows.withColumn("place", F.explode(places("id")))
    rows = rows.select((F.col("place") / 2).cast("int").alias("piece"), (F.col("place") % 2 == 1).alias("tail"), "doc_id", "id", "h", "text")
    return rows.repartitionById(n, "piece").sortWithinPartitions("piece", "tail", F.desc("id"), "h")  # a piece a task


def edited_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Next is the next document in descending id (ties by text key), after the last the first."""
    known = _shared(docs.sparkSession, lexicon(docs, low, high, text))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, rows = None, None, []  # held: the row that waits for its next

        def pair(following: str, after: np.ndarray) -> None:
            key, body, own = held
            edited = edited_text(body, following)
            changed = fingerprint(edited, known.value)
            sha = hashlib.sha256(edited.encode()).hexdigest()
            rows.append((key, len(body), sha, as_text(own), as_text(changed), likeness(own, changed), likeness(own, after)))

        for batch in batches:
            for at, tail, key, body in zip(*(batch.column(c) for c in ("piece", "tail", "doc_id", "text"))):
                at, tail, body = at.as_py(), tail.as_py(), body.as_py() or ""
                if at != piece:
                    piece, held = at, None
                if tail and held is None:
                    continue
                own = fingerprint(body, known.value)
                if held is not None:
                    pair(body, own)
                held = None if tail else (key.as_py(), body, own)
            if rows:
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))], names=names)
                rows.clear()

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs, doc_id, text).mapInArrow(run, schema)
