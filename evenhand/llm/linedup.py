"""Line dedup: later copies of repeated line runs are deleted, native.

Documents are sequences of lines; a run of consecutive lines with at least ``min_words`` blank-separated words that
stands at an earlier place too (smaller id, then text key, then line number) is a copy, wherever it lies in a document,
and its lines go. The first copy stays, and so do shorter runs such as a common one-line notice.

1. Documents of equal text are one sequence, owned by the smallest id. Lines are collapsed before the shuffle.
2. Only lines that occur twice can be part of a copy: the sequences are cut into stretches of such lines, and stretches
   with fewer than ``min_words`` words are out. The lines left get dense ids by a distributed sort.
3. Suffix array by prefix doubling: the rank of every suffix by its first 1, 2, 4, ... lines. Each round sorts the pairs
   (rank here, rank 2^k lines further) by ranges over all tasks and takes prefix sums, so a frequent line is counted,
   never gathered. The rounds end when the longest minimal run is covered.
4. The shortest run of ``min_words`` words that starts (ends) at a line is an interval of the suffix array: the suffixes
   that share so many lines. Two overlapping powers of two give it exactly: its length, the rank of its first 2^k lines
   and the rank of its last 2^k lines. In each interval the first copy stays. Every line of every longer repeated run
   lies in such a shortest run, so maximal runs go as a whole.

Defined cases: null text has no lines and stays null; an empty text is one empty line; equal rows (same id, same text)
are one document and get the same answer; null ids come first; a whole copied document becomes an empty text when it has
``min_words`` words; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.llm.common import cut, id_key, n_blank_words, packed, running, text_key, unpacked

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``h, ln, a, b, words, id, last_id``: the lines of each distinct text, their 128-bit content, and the text's smallest
    and largest id."""
    rows = docs.where(F.col(text).isNotNull()).select(
        id_key(F.col(doc_id)).alias("id"), text_key(F.col(text)).alias("h"), F.posexplode(_lines(F.col(text))).alias("ln", "line")
    )
    rows = rows.select("id", "h", "ln", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), n_blank_words(F.col("line")).alias("words"))
    return rows.groupBy("h", "ln").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("words").alias("words"))


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """The lines that occur more than once, in stretches of consecutive ones with at least ``min_words`` words.

    Adds ``stretch``, and ``upto``: the stretch's words up to and with the line."""
    # from a checkpoint, so that the join deals out both sides itself and can split a frequent line's partition
    repeated = cut(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    in_doc = Window.partitionBy("h").orderBy("ln")
    rows = lines.drop("last_id").join(repeated, ["a", "b"]).drop("copies").withColumn("stretch", F.col("ln") - F.row_number().over(in_doc))
    whole = Window.partitionBy("h", "stretch")
    rows = rows.withColumn("upto", F.sum("words").over(whole.orderBy("ln"))).withColumn("total", F.max("upto").over(whole))
    return rows.where(F.col("total") >= min_words).drop("total")


def minimal_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """``h, id, start, len``: the shortest run of ``min_words`` words from each line on, and up to each line."""
    stretch = Window.partitionBy("h", "stretch")
    rows = rows.withColumn("ahead", F.col("upto") - F.col("words"))
    last = F.max(F.struct("ln", "upto")).over(stretch.orderBy("ahead").rangeBetween(Window.currentRow, min_words - 1))
    first = F.min(F.struct("ln", "ahead")).over(stretch.orderBy("upto").rangeBetween(-(min_words - 1), Window.currentRow))
    rows = rows.withColumn("last", last).withColumn("first", first)
    onwards = rows.where(F.col("last.upto") - F.col("ahead") >= min_words).select("h", "id", F.col("ln").alias("start"), (F.col("last.ln") - F.col("ln") + 1).alias("len"))
    upwards = rows.where(F.col("upto") - F.col("first.ahead") >= min_words).select("h", "id", F.col("first.ln").alias("start"), (F.col("ln") - F.col("first.ln") + 1).alias("len"))
    return onwards.union(upwards).distinct()


def suffix_ranks(rows: DataFrame, longest: int) -> DataFrame:
    """``h, ln, ranks``: ranks[k] is the number of suffixes whose first 2^k lines sort before this one's; equal runs of
    2^k lines share it. Suffixes end with their stretch (a shorter one sorts first). Up to 2^k <= ``longest``."""
    ids = running(cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))), ["a", "b"], ["n"])
    ranks = rows.join(ids, ["a", "b"]).select("h", "ln", "stretch", F.array("before_n").alias("ranks"), F.col("before_n").alias("rank"))
    step = 1
    while 2 * step <= longest:
        further = F.lead("rank", step, -1).over(Window.partitionBy("h", "stretch").orderBy("ln"))
        pairs = cut(ranks.withColumn("next", further))
        groups = running(cut(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))), ["rank", "next"], ["n"])
        joined = pairs.join(groups, ["rank", "next"])
        ranks = joined.select("h", "ln", "stretch", F.array_append("ranks", F.col("before_n")).alias("ranks"), F.col("before_n").alias("rank"))
        step *= 2
    return cut(ranks.select("h", "ln", "ranks"))


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, start, len``: line runs of the text with key ``h`` that stand at an earlier place too; ``lines`` of
    :func:`line_table`."""
    rows = cut(stretches(lines, min_words))
    runs = cut(minimal_runs(rows, min_words))
    longest = runs.agg(F.coalesce(F.max("len"), F.lit(1))).first()[0]
    ranks = suffix_ranks(rows, longest)
    runs = runs.withColumn("k", F.length(F.bin("len")) - 1)  # 2^k <= len < 2^(k+1)
    runs = runs.withColumn("tail", (F.col("start") + F.col("len") - F.expr("shiftleft(1, k)")).cast("int"))
    head = ranks.select("h", F.col("ln").alias("start"), F.col("ranks").alias("head_ranks"))
    tail = ranks.select("h", F.col("ln").alias("tail"), F.col("ranks").alias("tail_ranks"))
    interval = [F.col("len"), F.get("head_ranks", F.col("k")).alias("head"), F.get("tail_ranks", F.col("k")).alias("foot")]
    members = cut(runs.join(head, ["h", "start"]).join(tail, ["h", "tail"]).select(F.struct("id", "h", "start").alias("place"), *interval))
    firsts = cut(members.groupBy("len", "head", "foot").agg(F.min("place").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    later = members.join(firsts, ["len", "head", "foot"]).where(F.col("place") != F.col("kept"))
    return later.select("place.h", "place.start", "len")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_lines") -> DataFrame:
    """The rows of ``docs`` with later copies deleted from ``text``, and the array ``removed`` of the deleted line
    numbers (from 0, in order; it replaces a column of that name). Extra columns pass through."""
    lines = cut(line_table(docs, doc_id, text))
    numbers = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("ln")
    deleted = later_copies(lines, min_words).select("h", numbers).groupBy("h").agg(F.array_sort(F.collect_set("ln")).alias("_lines"))
    owners = lines.where("id != last_id").groupBy("h").agg(F.min("id").alias("_first"), F.sum("words").alias("words"))
    copied = owners.where(F.col("words") >= min_words).select("h", "_first")
    known = cut(copied.join(deleted, "h", "full"))  # so that the partition of a text with many copies can be split
    joined = packed(docs, doc_id, text).join(known, "h", "left")
    body = joined["row"][text]
    is_copy = F.coalesce(F.col("id") != F.col("_first"), F.lit(False))
    everything = F.sequence(F.lit(0), F.size(_lines(body)) - 1)
    gone = F.when(body.isNull(), None).when(is_copy, everything).otherwise(F.coalesce("_lines", F.array().cast("array<int>")))
    joined = joined.withColumn("gone", gone)
    kept = F.transform(F.array_except(everything, "gone"), lambda i: F.get(_lines(body), i))
    cleaned = F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(body)
    columns = unpacked(joined, [c for c in docs.columns if c != removed], **{text: cleaned})
    return joined.select(*columns, F.col("gone").alias(removed))
