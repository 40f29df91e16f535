"""Mixing sources to target weights, native.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share as many words as there are; a source's target
stops at ``most`` times its size and the excess goes to the others by weight: target = min(most * size, share * weight)
for the one share at which the targets add up. Documents get hash-random keys and are range-sorted within their source;
distributed prefix sums of their words find the document at which the source's budget ends. Whole epochs repeat all
documents; the last epoch stops inside that document, so a source's words add up to its target to the word.

The only per-source state is one row (epochs, key and words at the cut), joined with the documents; texts are never
shuffled. Keys come from id and content, so reruns and recomputed tasks agree.

Defined cases: null and empty texts have no words and are never taken; a null source is a source of its own; repeated rows
share one key, and where the cut falls on them each gives an equal part (rounded down); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import BLANKS, cut, n_blank_words, running, text_key, unpacked

WEIGHTS = (1, 2, 3)
MOST = 3


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash-random key of a document, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_key(text), F.lit(str(seed))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``no_source, source, source_size, weight, target`` from ``no_source, source, size`` rows."""
    sources = cut(sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one")))
    ranked = running(sources, ["no_source", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int")).cast("bigint")
    ranked = ranked.select("no_source", "source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    # In order of cap / weight the first sources are at their cap; the share follows from what the others have left.
    filled = cut(running(cut(ranked), ["ratio", "no_source", "source"], ["cap", "weight"]))
    totals = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = (F.col("all_size") - F.col("before_cap")).cast("double") / (F.col("all_weight") - F.col("before_weight"))
    level = filled.crossJoin(F.broadcast(totals)).where(share <= F.col("ratio")).agg(F.min(F.struct("ratio", share.alias("share"))).alias("at"))
    level = level.select(F.col("at.share").alias("share"))  # totals and level are one row each
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("share"), F.lit(float("inf"))) * F.col("weight"))
    return filled.crossJoin(F.broadcast(level)).select("no_source", "source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """``(documents, cuts)``: a row ``doc_id, no_source, source, size, key`` for each document and one row for each
    source: ``source_size, target, epochs`` (whole ones), and ``cut_key, cut_words`` (of each document with that key)
    where the last epoch stops (null: it takes nothing)."""
    documents = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source"),
            n_blank_words(F.col(text)).alias("size"), _key(F.col(doc_id), F.col(text), seed).alias("key"),
        )
    )
    targets = source_targets(documents.select("no_source", "source", "size"), weights, most)
    budget = F.floor("target").cast("bigint")
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(budget / size)).otherwise(0).cast("bigint")
    epochs = F.when(epochs * size > budget, epochs - 1).otherwise(epochs)
    targets = cut(targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * size))
    groups = cut(documents.groupBy("no_source", "source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    ordered = running(groups, ["no_source", "source", "key"], ["words"])
    starts = running(targets, ["no_source", "source"], ["source_size"]).select("no_source", "source", "rest", F.col("before_source_size").alias("start"))
    placed = ordered.join(starts, ["no_source", "source"]).withColumn("left", F.col("rest") - (F.col("before_words") - F.col("start")))
    ends = placed.where((F.col("left") > 0) & (F.col("left") <= F.col("words")))
    ends = ends.select("no_source", "source", F.col("key").alias("cut_key"), F.expr("left div rows").alias("cut_words"))
    ends = cut(ends)  # at most a row per source; the join above can split a large source's partition
    return documents, cut(targets.join(ends, ["no_source", "source"], "left").drop("weight", "rest"))


def _last_epoch(size: Column, key: Column) -> Column:
    """Words that the unfinished epoch takes of a document."""
    cut_key = F.col("cut_key")
    return F.when(key < cut_key, size).when(key == cut_key, F.col("cut_words")).otherwise(F.lit(0)).cast("bigint")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: what the mix takes of each document, repeats counted."""
    documents, cuts = plan(docs, **options)
    taken = F.col("epochs") * F.col("size") + _last_epoch(F.col("size"), F.col("key"))
    return documents.join(cuts, ["no_source", "source"]).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, epoch: str = "epoch", seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, once for each epoch (from 0) that takes them. The one document in
    which the last epoch stops gives its first words, joined by blanks."""
    _, cuts = plan(docs, seed=seed, doc_id=doc_id, text=text, source=source, **options)
    name = docs[source]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), name.isNull().alias("no_source"), F.coalesce(name, F.lit("")).alias("source"),
        n_blank_words(docs[text]).alias("size"), _key(docs[doc_id], docs[text], seed).alias("key"),
    )
    rows = rows.join(cuts, ["no_source", "source"]).withColumn("part", _last_epoch(F.col("size"), F.col("key")))
    # one condition over both sides of the join: a filter on the size alone would count the words once more below it
    rows = rows.where(F.col("epochs") * F.col("size") + F.col("part") > 0).withColumn("all_epochs", F.col("epochs") + (F.col("part") > 0).cast("bigint"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("all_epochs") - 1)))
    body = rows["row"][text]
    shortened = F.array_join(F.slice(F.array_remove(F.split(body, BLANKS), ""), 1, F.col("part").cast("int")), " ")
    body = F.when((F.col("epoch") == F.col("epochs")) & (F.col("part") < F.col("size")), shortened).otherwise(body)
    columns = unpacked(rows, [c for c in docs.columns if c != epoch], **{text: body})
    return rows.select(*columns, F.col("epoch").alias(epoch))
