"""URL filters: fixed host and path rules, then association rules mined from labels.

Fixed rules name a host and a path prefix; they hold for the host and its subdomains, and the longest one wins.
Pages no fixed rule decides are judged by association rules:

1. a URL is a set of tokens (host labels with their place, path segments, extension, query names and values);
2. tokens that stand in exactly the same labelled pages (the parts of one host, say) can't tell pages apart and are one item, a
   class; Spark's FP-growth mines combinations of classes that are frequent among the labelled pages;
3. a combination with a share of bad pages of at least ``confidence`` blocks, with a share of good ones of at least
   ``confidence`` allows. The share has to be above the average by ``lift`` too or, where that average leaves little or no
   room for it, to close ``gap`` of the way from the average to 1; combinations that a part of them already decides go;
4. each rule is listed under the tokens of its rarest class only (an inverted index), so common tokens match nothing; a
   listed rule fires where the page has a token of each of its classes. The most confident rule that fires decides, then the better supported,
   then the text order; without one a page is allowed.

All labelled pages are mined, and every page is judged.

Defined cases: a null url or one without ``://`` has empty host and path, no tokens, and is allowed; pages without a
label only miss the training; repeated rows each get the same answer; no labels mean no mined rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import LOWER, UPPER, cut

# Verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, LEAST, CONFIDENCE, LIFT, GAP = 0.005, 20, 0.6, 1.5, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, else null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits = F.when(hit, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL, marked by the place they come from; running numbers lose their value."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != "")
    sets = F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.when(host != "", F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_replace(x, "[0-9]+", "0"))),
    )
    return F.filter(F.array_distinct(sets), lambda x: ~x.isin("w:"))


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, lift: float | None = None, longest: int | None = None, gap: float = GAP) -> DataFrame:
    """``tokens, alike, verdict, share, support, rarest``: pruned rules from ``tokens, bad`` rows. A class is named by its first
    token; ``alike`` has all tokens of each class, in the order of ``tokens``.

    Support is a share of the labelled pages (of ``least`` pages at least), so the number of frequent combinations depends on how URLs are made, not on
    how many there are. Combinations have any number of tokens, or at most ``longest``. A given ``lift`` holds as it is, also
    where no share can reach it; without one it is ``LIFT``, bounded by ``gap``."""
    from pyspark.ml.fpm import FPGrowth

    rows = cut(labelled.where((F.size("tokens") > 0) & F.col("bad").isNotNull()))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    schema = "tokens array<string>, alike array<array<string>>, verdict string, share double, support bigint, rarest string"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    mark = F.when(F.col("bad"), F.lit("=bad")).otherwise(F.lit("=good"))
    wanted = min(1.0, max(support, least / n))
    rows = rows.select(F.monotonically_increasing_id().alias("page"), "tokens", mark.alias("mark"))  # rows are a checkpoint: the numbers stay
    # a token's page set by its size and 128 bits; at most (mean tokens of a page) / support tokens are frequent
    pages = rows.select("page", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"), F.expr("bit_xor(xxhash64(page))").alias("x"), F.expr("bit_xor(xxhash64(page, 1))").alias("y")
    ).where(F.col("freq") >= wanted * n - 1e-9)
    classes = cut(pages.groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("alike")).select(F.get("alike", F.lit(0)).alias("token"), "alike", "freq"))
    names = F.broadcast(classes.select(F.col("token").alias("item"), F.explode("alike").alias("token")))
    items = rows.select("page", "mark", F.explode_outer("tokens").alias("token")).join(names, "token", "left")
    baskets = items.groupBy("page", "mark").agg(F.collect_set("item").alias("items")).select(F.array_append("items", F.col("mark")).alias("items"))
    sets = cut(FPGrowth(itemsCol="items", minSupport=wanted).fit(baskets).freqItemsets)
    marked = sets.where(F.array_contains("items", "=bad") | F.array_contains("items", "=good"))
    plain = sets.where(~F.array_contains("items", "=bad") & ~F.array_contains("items", "=good"))
    if longest is not None:
        plain = plain.where(F.size("items") <= longest)
    plain = plain.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    sides = marked.select(
        F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("tokens"), F.when(F.array_contains("items", "=bad"), "block").otherwise("allow").alias("verdict"), F.col("freq").alias("support")
    ).where(F.size("tokens") > 0)
    base = F.when(F.col("verdict") == "block", bad / n).otherwise((n - bad) / n)
    rules = sides.join(plain, "tokens").withColumn("share", F.col("support") / F.col("all"))
    above = F.least(LIFT * base, base + gap * (1 - base)) if lift is None else lift * base
    rules = cut(rules.where((F.col("share") >= confidence) & (F.col("share") >= above)).select("tokens", "verdict", "share", "support"))
    # A rule goes if one of its parts decides alike with no less confidence. Parts that lack one token come first: they leave
    # few rules, and a part that goes itself has a part that covers what it covered. The others meet at the part's rarest token.
    lacking = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "share", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    part = rules.select(F.col("tokens").alias("part"), "verdict", F.col("share").alias("part_share"))
    covered = lacking.join(part, ["part", "verdict"]).where(F.col("part_share") >= F.col("share")).select("tokens", "verdict").distinct()
    rules = cut(rules.join(covered, ["tokens", "verdict"], "left_anti"))
    spread = rules.select("tokens", "verdict", "share", "support", F.explode("tokens").alias("token")).join(classes, "token")
    members = F.transform(F.array_sort(F.collect_list(F.struct("token", "alike"))), lambda c: c["alike"])
    named = spread.groupBy("tokens", "verdict", "share", "support").agg(F.min(F.struct("freq", "token")).alias("least"), members.alias("alike"))
    rules = cut(named.select("tokens", "alike", "verdict", "share", "support", F.col("least.token").alias("rarest")))
    listed = rules.select("rarest", "verdict", F.col("tokens").alias("part"), F.col("share").alias("part_share"))
    longer = rules.where(F.size("tokens") > 2).select("tokens", "verdict", "share", F.explode("tokens").alias("rarest")).join(listed, ["rarest", "verdict"])
    is_part = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0)
    covered = longer.where(is_part & (F.col("part_share") >= F.col("share"))).select("tokens", "verdict").distinct()
    return rules.join(covered, ["tokens", "verdict"], "left_anti")


def judge(pages: DataFrame, labels: DataFrame | None, page_id: str = "page_id", url: str = "url", rules=RULES, label_id: str = "doc_id", bad: Column | None = None, **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for each row of ``pages``: ``rule`` is the fixed rule that decided,
    ``mined`` the classes (by their first tokens) of the mined rule that fired on the others. ``labels`` has the ids of labelled pages; ``bad`` tells
    the bad ones (default: low quality or toxic)."""
    address = F.col(url)
    base = pages.select(F.col(page_id).alias("page_id"), address.alias("url"), host_of(address).alias("host"), path_of(address).alias("path"), tokens_of(address).alias("tokens"))
    base = base.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        fired = None
    else:
        bad = bad if bad is not None else (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
        known = labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")).where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
        mined = cut(mine(base.join(known, "page_id").select("tokens", "bad"), **options))
        urls = base.where(F.col("fixed").isNull()).select("url", "tokens").dropDuplicates(["url"])
        open_ = urls.select("url", "tokens", F.explode("tokens").alias("rarest"))
        index = F.explode(F.element_at("alike", F.array_position("tokens", F.col("rarest")).cast("int")))
        listed = mined.select(index.alias("rarest"), F.col("tokens").alias("needed"), "alike", "verdict", "share", "support")
        fired = open_.join(listed, "rarest").where(F.forall("alike", lambda c: F.arrays_overlap(c, F.col("tokens"))))
        order = F.struct(-F.col("share"), -F.col("support"), "needed", "verdict")
        fired = fired.groupBy("url").agg(F.min(order).alias("best")).select(F.col("url").alias("fired_url"), F.col("best.needed").alias("mined"), F.col("best.verdict").alias("mined_verdict"))
    if fired is None:
        empty = F.lit(None)
        out = base.withColumns({"mined": empty.cast("array<string>"), "mined_verdict": empty.cast("string")})
    else:
        out = base.join(fired, base["url"] == fired["fired_url"], "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.col("mined_verdict"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fixed").isNull(), F.array_join("mined", " ")).alias("mined"))
