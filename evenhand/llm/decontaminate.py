"""Benchmark decontamination: prefix-filtered join of benchmark windows with documents, native.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window). It is in a document when its
words stand there in a row, so all of its shingles are in the document, and its rarest shingle alone is a sufficient
prefix. The steps:

1. every benchmark shingle is counted over all documents (partial sums, no document leaves its task);
2. each window keeps its rarest shingle as prefix; a window with a shingle that no document has is out;
3. prefixes are joined with the documents' shingles; the prefix's place in the window gives the start (positional
   bound), which has to leave room for the window (length bound); the words there must equal the window's.

The benchmark side is broadcast in blocks of a bounded size, one pass over the documents for each block; the documents
are never shuffled, so a hot word or passage lands in no single task.

Defined cases: null and empty texts have no words; items without words have no windows; a window in many items counts
for each; repeated rows each get the same answer; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import blocks, cut, id_key, packed, same, text_key, unpacked, words_of


def _shingle(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start + i) for i in range(n)])


def item_windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, words``: the windows of each item, repeats included."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))


def _occurrences(docs: DataFrame, shingle: int, *kept: str) -> DataFrame:
    """One row per word position (and one past the last): ``at``, and the shingle ``sh`` that starts there."""
    rows = docs.select(*kept, "words", F.size("words").alias("n_words"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("at"))
    return rows.withColumn("sh", F.when(F.col("at") + shingle <= F.col("n_words"), _shingle(F.col("words"), F.col("at"), shingle)))


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int, most: int) -> DataFrame:
    """``phrase, len, shingle, sh, offset``: each distinct window that can occur at all, with its rarest shingle.

    ``docs`` has ``words``; ``most`` bounds the bytes broadcast at once."""
    distinct = windows.groupBy("words").agg(F.lit(1)).select("words", F.size("words").alias("len"))
    parts = []
    for n in range(1, shingle + 1):  # windows of fewer words than a shingle are one shingle
        of = distinct.where((F.col("len") == n) if n < shingle else (F.col("len") >= n))
        offsets = F.explode(F.sequence(F.lit(0), F.col("len") - n)).alias("offset")
        parts.append(of.select("words", "len", F.lit(n).alias("shingle"), offsets).withColumn("sh", _shingle(F.col("words"), F.col("offset"), n)))
    shingles = cut(reduce(DataFrame.union, parts).withColumn("phrase", F.array_join("words", " ")).drop("words"))
    counts = []
    for row in shingles.groupBy("shingle").agg(F.lit(1)).select("shingle").collect():  # at most `shingle` numbers
        known = shingles.where(F.col("shingle") == row["shingle"]).select("sh").distinct()
        for part in blocks(known, "sh", F.lit(16), most):
            found = _occurrences(docs, row["shingle"]).select("sh").join(F.broadcast(part), "sh")
            counts.append(found.groupBy("sh").agg(F.count(F.lit(1)).alias("n")).withColumn("shingle", F.lit(row["shingle"])))
    if not counts:
        return shingles
    counts = cut(reduce(DataFrame.union, counts))
    ranked = shingles.join(counts, ["sh", "shingle"], "left").groupBy("phrase", "len", "shingle").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "offset")).alias("rarest")
    )
    return ranked.where("rarest.n > 0").select("phrase", "len", "shingle", "rarest.sh", "rarest.offset")


def find_windows(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 5, most: int = 32 << 20,
    doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences of the benchmark's windows.

    Returns ``(documents, hits)``: ``documents`` has ``doc_id, id, h, n_words`` for each row of ``docs``; ``hits`` has
    ``id, h, start, len, phrase`` for each occurrence (words count from 0). ``id, h`` (the id with a stand-in for null,
    and the text's 128-bit key) identify a document.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), id_key(F.col(doc_id)).alias("id"), text_key(F.col(text)).alias("h"), words_of(F.col(text)).alias("words"))
    candidates = cut(prefixes(named, item_windows(benchmark, size, item, item_text), shingle, most))
    lengths = [r["shingle"] for r in candidates.groupBy("shingle").agg(F.lit(1)).collect()]  # at most `shingle` numbers
    base, hits = None, []
    for n in sorted(lengths, reverse=True) or [shingle]:
        for part in blocks(candidates.where(F.col("shingle") == n).drop("shingle"), "phrase", F.octet_length("phrase") + 64, most):
            rows = _occurrences(named, n, "doc_id", "id", "h").join(F.broadcast(part), "sh", "left")
            start = F.col("at") - F.col("offset")
            fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
            equal = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("phrase")
            past_end = F.col("at") == F.col("n_words")  # the row that stands for the document itself
            is_hit = F.col("phrase").isNotNull() & fits & equal
            wanted = is_hit if base is not None else is_hit | past_end
            found = cut(
                rows.where(wanted).select("doc_id", "id", "h", "n_words", "phrase", "len", start.alias("start"), past_end.alias("is_doc"))
            )
            if base is None:
                base = found.where("is_doc").select("doc_id", "id", "h", F.col("n_words").cast("bigint").alias("n_words"))
            hits.append(found.where(~F.col("is_doc")).select("id", "h", "start", "len", "phrase"))
    return base, reduce(DataFrame.union, hits)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document row ``doc_id, id, h, n_words, n_hit, n_items, items, contaminated``: words inside any occurrence of a
    window, and the items (as strings, sorted) whose windows occur. Options as in :func:`find_windows`."""
    base, hits = find_windows(docs, benchmark, **options)
    item, item_text = options.get("item", "item_id"), options.get("item_text", "text")
    owners = item_windows(benchmark, options.get("size", 10), item, item_text).select("item", F.array_join("words", " ").alias("phrase")).distinct()
    hits = hits.distinct()
    covered = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("at")
    n_hit = hits.select("id", "h", covered).distinct().groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("id", "h", "phrase").distinct().join(owners, "phrase").groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = n_hit.join(items, ["id", "h"], "left")
    out = base.join(per_doc, same(base, per_doc, "id", "h"), "left").drop(per_doc["id"]).drop(per_doc["h"])
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    _, hits = find_windows(docs, benchmark, doc_id=doc_id, text=text, **options)
    bad = hits.select("id", "h").distinct()
    rows = packed(docs, doc_id, text).join(bad, ["id", "h"], "left_anti")
    return rows.select(*unpacked(rows, docs.columns))
