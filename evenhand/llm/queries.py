"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm import decontaminate, imatch, langid, licenses, linedup, mixing, packing, secretscan, simhash, toolcalls, trie, urlrules, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no tool calls, so events are derived from their turns (:func:`toolcalls.derived_events`)."""
    linked = toolcalls.link(toolcalls.derived_events(_table(spark, sf_dir, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    out = linedup.dedup_lines(docs)
    return out.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("removed_lines", F.array().cast("array<int>"))).cast("bigint").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"),
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry neither address nor markup: declared language and text, and the source as a host without levels."""
    found = langid.identify(_table(spark, sf_dir, "documents"), declared="lang", host="source")
    return found.select("doc_id", "declared", "language", "confidence", "text_language", "kept")


def op8_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with all evidence: text and markup language of the html, host and suffix of the address."""
    html = F.col("html")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", langid.markup_language(html).alias("lang"), langid.page_text(html).alias("text"))
    found = langid.identify(pages, declared="lang", url="url", doc_id="page_id")
    return found.select(F.col("doc_id").alias("page_id"), "declared", "language", "confidence", "text_language", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", "run", F.sha2("core", 256).alias("core_sha256"), "length", "changes", "coverage", "label", "probability", "is_secret")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(_table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return trie.trie(trie.branched(trie.sequences(turns)), turns.count())


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_imatch, op2_tool_calls, op3_url_rules, op4_simhash, op5_decontamination, op6_line_dedup, op7_source_mixing, op8_language, op8_page_language, op9_secrets, op10_licenses, op11_prefix_trie, op12_best_fit, op13_whitening)
}
