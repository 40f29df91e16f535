"""Language ID by Bayesian evidence fusion.

posterior(l) ~ prior(l | host) * P(text | l) * P(declared | l) * P(suffix | l)

- Text: letter trigrams, hashed; a naive Bayes model fitted on a bounded sample of the rows of each declared language, plus the
  class ``und`` (all trigrams alike) for text in no known language. Neighbouring trigrams depend on each other, so the sum
  of log-likelihoods counts as at most ``evidence`` independent ones.
- Declared markup language and address suffix (first path segment of two letters, else the last label of the host): their
  chances given the language, from grouped counts over all rows by the language their text alone suggests.
- Host priors: grouped counts over all rows, smoothed level by level: corpus, parent domain (a host without its first
  label), host. A level's counts are added to ``strength`` rows of the level above.

Texts are read once; what follows works on one narrow row for each document. A host's rows are counted before they are
shuffled and its prior is one row, so a hot host is no large group.

Defined cases: null, empty and letterless texts are ``und`` and rejected; a missing or unseen declared language, suffix or
host says nothing; without any declared language in the corpus all is ``und``; repeated rows get the same answer. A text of
a declared language with too few rows for a model is not rejected: it keeps its declared language where the others don't fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import cut, id_key, packed, text_key, unpacked

BUCKETS = 1 << 15
SAMPLE = 20_000  # rows of each declared language the text model is fitted on, at most about
LEAST_ROWS = 5  # a language needs so many rows with letters
TAG = "^(?!und|mul|mis|zxx|q[a-t][a-z])[a-z]{2,3}$"  # a primary language subtag (BCP 47) that names a language
EVIDENCE = 60.0
STRENGTH = 20.0
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def trigrams(text: str | None) -> np.ndarray:
    """Hashed letter trigrams of the lower-cased text; all else separates words."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = (codes >= 0x10000) | _is_letter()[np.minimum(codes, 0xFFFF)]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one separator between words
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)


class TextModel:
    """Log-chances of trigrams by language; the last row is ``und``."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        self.table = np.full((BUCKETS, len(self.languages)), -np.log(BUCKETS), dtype=np.float32)
        for i in range(len(languages)):
            smooth = counts[i] + 0.1
            self.table[:, i] = np.log(smooth / smooth.sum())

    def score(self, text: str | None, evidence: float = EVIDENCE) -> list[float] | None:
        """Log-likelihood of the text for each language; None without letters."""
        grams = trigrams(text)
        if not len(grams):
            return None
        total = np.zeros(len(self.languages))
        for lo in range(0, len(grams), 1 << 16):
            total += self.table[grams[lo : lo + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return (total * min(1.0, evidence / len(grams))).tolist()


def fit_text_model(docs: DataFrame, declared: str, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> TextModel:
    """In how many of about ``sample`` rows of each declared language each trigram occurs; rows are chosen by a hash of their id,
    text length and language. Rows count, not places, so that one long wrongly declared text weighs little."""
    lang = _language(F.col(declared))
    sizes = docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).where(F.col("lang").rlike(TAG) & (F.col("n") >= LEAST_ROWS))
    limits = [(r["lang"], -(-sample * (1 << 20) // r["n"])) for r in sizes.collect()]  # one row for each real tag
    limits = docs.sparkSession.createDataFrame(limits, "lang string, limit bigint")
    draw = F.pmod(F.xxhash64(id_key(F.col(doc_id)), F.octet_length(text), declared), F.lit(1 << 20))
    rows = docs.select(lang.alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    chosen = rows.join(F.broadcast(limits), "lang").where(F.col("draw") < F.col("limit")).select("lang", "text")

    def flush(counts: dict[str, np.ndarray], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            columns = [pa.array([lang] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int32()), pa.array([seen[lang], *c[at].tolist()], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "gram", "n"])
        counts.clear()
        seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in counts:
                    if len(counts) == 64:  # a task's memory
                        yield from flush(counts, seen)
                    counts[lang], seen[lang] = np.zeros(BUCKETS, dtype=np.int64), 0
                grams = np.unique(trigrams(body.as_py()))
                counts[lang] += np.bincount(grams, minlength=BUCKETS)
                seen[lang] += len(grams) > 0
        yield from flush(counts, seen)

    grams = cut(chosen.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = grams.where("gram = -1").select("lang", "n")
    languages = sorted(r["lang"] for r in sizes.where(F.col("n") >= LEAST_ROWS).collect())  # one row for each real tag
    counts = np.zeros((len(languages), BUCKETS), dtype=np.float32)
    known = grams.where(F.col("gram") >= 0).toArrow()  # at most BUCKETS rows for each real tag
    at = pc.index_in(known.column("lang"), pa.array(languages, pa.string())).combine_chunks().to_numpy(zero_copy_only=False)
    has = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), dtype=bool)
    counts[at[has].astype(np.int64), known.column("gram").to_numpy()[has]] = known.column("n").to_numpy()[has]
    return TextModel(languages, counts)


def _language(tag: Column) -> Column:
    """Primary language of a tag such as en-US."""
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of the html element, null if there is none."""
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))


_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[a-z/!?][^<>]*>")


def page_text(html: Column) -> Column:
    """The text of a page: no markup, comments, scripts or styles, and entities as the characters they stand for."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: unescape(_HIDDEN.sub(" ", x)) if isinstance(x, str) else None)

    return F.pandas_udf(run, "string")(html)


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case), and suffix: a first path segment of two letters, else the last label of the host."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))
    segment = F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)), F.lit(""))
    return host, F.coalesce(F.concat(F.lit("/"), segment), F.concat(F.lit("."), F.nullif(F.element_at(F.split(host, r"\."), -1), F.lit(""))))


def _chances(rows: DataFrame, key: str, languages: list[str], name: str) -> DataFrame:
    """``key, name``: log P(key | language) for each language, from counts of ``guess`` with one added everywhere."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, "guess").agg(F.count(F.lit(1)).alias("n"))
    table = cut(counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("guess") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(languages))]))
    totals = table.agg(F.count(F.lit(1)).alias("values"), *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(languages))]).first()
    logs = [F.log((F.col(f"n{i}") + 1.0) / F.lit(float(totals[f"t{i}"] + totals["values"]))) for i in range(len(languages))]
    return table.select(key, F.array(*logs).alias(name))


def _counts_by(rows: DataFrame, key: str, n: int) -> DataFrame:
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, "guess").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("guess") == i, F.col("n"))), F.lit(0)).alias(f"{key}_{i}") for i in range(n)])


def host_priors(rows: DataFrame, languages: list[str], strength: float = STRENGTH) -> tuple[DataFrame, list[float]]:
    """``(host, prior)`` rows, prior an array of log-chances, and the corpus-wide log-chances. ``rows``: ``host, guess``."""
    n = len(languages)
    whole = {r["guess"]: r["n"] for r in rows.groupBy("guess").agg(F.count(F.lit(1)).alias("n")).collect()}  # n rows
    total = sum(v for k, v in whole.items() if k is not None)
    corpus = [(whole.get(i, 0) + 1.0) / (total + n) for i in range(n)]
    parent = F.nullif(F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1), F.lit(""))
    rows = rows.withColumn("parent", F.coalesce(parent, F.col("host")))
    hosts = _counts_by(rows, "host", n).withColumn("parent", F.coalesce(parent, F.col("host")))
    joined = hosts.join(_counts_by(rows, "parent", n), "parent")

    def blend(key: str, above: list[Column]) -> list[Column]:
        all_ = sum((F.col(f"{key}_{i}") for i in range(1, n)), F.col(f"{key}_0"))
        return [(F.col(f"{key}_{i}") + strength * above[i]) / (all_ + strength) for i in range(n)]

    prior = blend("host", blend("parent", [F.lit(c) for c in corpus]))
    return joined.select("host", F.array(*[F.log(p) for p in prior]).alias("prior")), [float(np.log(c)) for c in corpus]


def identify(
    docs: DataFrame, declared: str | None = "lang", host: str | None = None, url: str | None = None, doc_id: str = "doc_id", text: str = "text",
    sample: int = SAMPLE, evidence: float = EVIDENCE, strength: float = STRENGTH, least: float = 0.5, model: TextModel | None = None,
) -> DataFrame:
    """``doc_id, id, h, declared, language, confidence, text_language, kept`` for each row of ``docs``.

    ``declared``, ``host`` and ``url`` name the columns with the evidence (``url`` gives host and suffix). A row is kept
    if its language is known and has a posterior of at least ``least``, or if it has letters and declares a real language that
    has no text model: such a row keeps its declared language, with no confidence, where none of the others reaches ``least``.
    ``model`` replaces the fitted text model."""
    nothing = F.lit(None).cast("string")
    tag = F.col(declared) if declared else nothing
    model = model or fit_text_model(docs.withColumn("_tag", tag), "_tag", text, doc_id, sample)
    languages, n = model.languages, len(model.languages)
    from_url = address_parts(F.col(url)) if url else (nothing, nothing)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), id_key(F.col(doc_id)).alias("id"), text_key(F.col(text)).alias("h"),
        _language(tag).alias("declared"), (F.col(host).cast("string") if host else from_url[0]).alias("host"), from_url[1].alias("suffix"), F.col(text).alias("text"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py(), evidence) for t in batch.column("text")]
            guess = [None if s is None else int(np.argmax(s)) for s in scores]
            columns = [batch.column(c) for c in ("doc_id", "id", "h", "declared", "host", "suffix")]
            yield pa.record_batch([*columns, pa.array(scores, pa.list_(pa.float64())), pa.array(guess, pa.int32())], names=[*names, "scores", "guess"])

    names = ["doc_id", "id", "h", "declared", "host", "suffix"]
    scored = cut(rows.mapInArrow(score, "doc_id bigint, id bigint, h string, declared string, host string, suffix string, scores array<double>, guess int"))
    counted = scored.where(F.col("guess").isNotNull()).select("declared", "host", "suffix", "guess")
    priors, corpus = host_priors(counted, languages, strength)
    fused = scored.join(_chances(counted, "declared", languages, "from_declared"), "declared", "left").join(_chances(counted, "suffix", languages, "from_suffix"), "suffix", "left")
    fused = fused.join(cut(priors), "host", "left")  # from a checkpoint: the join can split a hot host's partition
    zero = F.array_repeat(F.lit(0.0), n)
    logs = F.col("scores")
    for part in (F.coalesce("from_declared", zero), F.coalesce("from_suffix", zero), F.coalesce("prior", F.array(*[F.lit(c) for c in corpus]))):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    share = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    named = F.array(*[F.lit(x) for x in languages])
    best = F.when(F.col("guess").isNull(), F.lit(UNKNOWN)).otherwise(F.get(named, (F.array_position("logs", F.col("top")) - 1).cast("int")))
    fused = fused.select("doc_id", "id", "h", "declared", best.alias("language"), F.when(F.col("guess").isNull(), 0.0).otherwise(share).alias("confidence"), F.get(named, F.col("guess")).alias("text_language"))
    fused = fused.withColumn("known", (F.col("language") != UNKNOWN) & (F.col("confidence") >= least))
    unmodelled = F.coalesce(F.col("declared").rlike(TAG) & ~F.array_contains(named, F.col("declared")), F.lit(False))
    spared = ~F.col("known") & unmodelled & F.col("text_language").isNotNull()
    language, confidence = F.when(spared, F.col("declared")).otherwise(F.col("language")), F.when(~spared, F.col("confidence"))
    return fused.select("doc_id", "id", "h", "declared", language.alias("language"), confidence.alias("confidence"), "text_language", (F.col("known") | spared).alias("kept"))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known. Options as in :func:`identify`."""
    rejected = identify(docs, doc_id=doc_id, text=text, **options).where(~F.col("kept")).select("id", "h").distinct()
    rows = packed(docs, doc_id, text).join(rejected, ["id", "h"], "left_anti")
    return rows.select(*unpacked(rows, docs.columns))
