"""Secret scans with a random forest against false positives, native.

1. Candidates: all runs of letters, digits, ``+ / _ -`` in blank-separated tokens that have at least ``least`` characters and
   a digit, and of any length and kind those assigned to a trigger name (``password=...``, ``"token": "..."``).
2. Features of a candidate: its length; character transitions (share of changes between lower case, upper case, digits and
   others, share of each class, distinct characters); dictionary coverage (share of its characters in letter runs that are
   frequent words of the corpus); path (share of candidates among the words of its path, path separators); neighbouring
   words (assignment in the token, trigger words before, in and after it, share of words known to the dictionary before and
   after it). Dictionary words have 3 to 40 letters.
3. Labelled findings train Spark's random forest. Findings come with the caller (``label`` 1 or 0). Without them evidence that
   is no feature of the forest labels what it decides: a fixed key format or an assignment to a trigger name is a secret; a
   number with a valid check digit, a UUID, a time stamp, and a value met between :data:`REPEATED` different neighbours
   are none; a value with evidence of both kinds has no label. That forest leaves out :data:`RULE`, the features that tell
   of an assignment.
4. Every value is judged by a forest that was not trained on it: values are dealt into two folds by a hash, and each fold's
   forest is fitted on a bounded sample of the other's findings. So ``probability`` against ``label`` is a held-out measure
   (:func:`held_out`).

All steps are DataFrame and JVM work. Candidates are few against the words; words are only counted, never gathered.

Defined cases: null and empty texts have no candidates; a null source is a source of its own; without findings of both
labels in the other fold there is no forest and the label, else 0.5, is the probability; repeated rows give repeated findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import BLANKS, cut, id_key, n_blank_words

LEAST = 12
TRIGGERS = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "access")
# Public formats of credentials.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z]{20,}|AIza[0-9A-Za-z_-]{35})$"
# The end of what stands before a value that is assigned to a trigger name.
NAMED = r"((?i:token|secret|password|passwd|pwd|credential|apikey)|((^|[^A-Za-z])(?i:key|auth|bearer|access)|[a-z](Key|Auth|Bearer|Access))(?![a-rt-z]))[A-Za-z0-9_-]*[\"'\])]*\x20?[=:]+>?[^A-Za-z0-9+/_-]*$"
# Public formats of identifiers that are no secrets (UUID, time stamps in ISO form).
IDENTIFIERS = r"^([0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-][0-9][0-9-]*Z?)?)$"
FREQUENT = 5  # a dictionary word occurs so often
REPEATED = 5  # an identifier stands between so many different neighbours
SAMPLE = 50_000  # labelled findings of each label a forest is fitted on, at most about
RULE = ["assigned", "word_before", "inside"]  # what the labels of :func:`known_label` are made of
CONTENT = ["length", "changes", "digits", "uppers", "lowers", "distinct", "coverage", "slashes", "path_rate", "known_before", "known_after", "word_after"]
FEATURES = CONTENT + RULE


def _share(core: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(core, f"[^{keep}]", "")) / F.length(core)


def _has_trigger(word: Column) -> Column:
    return F.coalesce(F.lower(word).rlike("|".join(TRIGGERS)), F.lit(False)).cast("double")


def candidates(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, id, path, at, run, core, before, token, after, named``: every candidate with its word number and its run's number in
    the word. ``token`` is the part of the word from the run before it up to its end, ``before`` the two runs or words before,
    ``after`` the next run or word."""
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), BLANKS)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), id_key(F.col(doc_id)).alias("id"), F.col(path).cast("string").alias("path"), pieces.alias("words"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at")).withColumn("word", F.get("words", F.col("at")))
    last = F.coalesce(F.get("words", F.col("at") - 1), F.lit(""))
    digits = (F.length("word") >= least) & F.col("word").rlike("[0-9]")
    sign = F.col("word").contains("=") | F.col("word").contains(":") | last.rlike(r"[=:]>?[^A-Za-z0-9+/_-]*$")
    rows = rows.where(digits | sign)
    found = lambda group: F.regexp_extract_all("word", F.lit(r"([^A-Za-z0-9+/_-]*)([A-Za-z0-9+/_-]+)"), F.lit(group))
    two = F.concat_ws(" ", F.get("words", F.col("at") - 2), F.get("words", F.col("at") - 1))
    rows = rows.select("doc_id", "id", "path", "at", two.alias("two"), last.alias("last"), F.get("words", F.col("at") + 1).alias("next"), found(1).alias("signs"), found(2).alias("runs"))
    rows = rows.where(F.size("runs") > 0).select("*", F.explode(F.sequence(F.lit(0), F.size("runs") - 1)).alias("run"))
    at = F.col("run")
    own, head = F.get("runs", at), F.concat(F.coalesce(F.get("runs", at - 1), F.lit("")), F.get("signs", at))
    before = F.when(at == 0, F.col("two")).otherwise(F.concat_ws(" ", F.when(at == 1, F.col("last")).otherwise(F.get("runs", at - 2)), F.get("runs", at - 1)))
    rows = rows.select("doc_id", "id", "path", "at", "run", own.alias("core"), before.alias("before"), F.concat(head, own).alias("token"), F.coalesce(F.get("runs", at + 1), F.col("next")).alias("after"), head.alias("head"))
    named = F.when(at == 0, F.col("before").rlike(NAMED)).otherwise(F.col("head").rlike(NAMED))
    rows = rows.withColumn("named", F.coalesce(named, F.lit(False))).drop("head")
    return rows.where(((F.length("core") >= least) & F.col("core").rlike("[0-9]")) | F.col("named"))


def dictionary(docs: DataFrame, pieces: DataFrame, frequent: int = FREQUENT, text: str = "text") -> DataFrame:
    """The ``piece`` values that are words of the corpus, at least ``frequent`` times. Counts all words, map side first."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), BLANKS)).alias("word"))
    counts = words.select(F.lower("word").alias("piece")).where(F.length("piece").between(3, 40)).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    return pieces.select("piece").distinct().join(counts.where(F.col("n") >= frequent), "piece").select("piece")


def features(found: DataFrame, docs: DataFrame, frequent: int = FREQUENT, text: str = "text", path: str = "source") -> DataFrame:
    """``found`` with the columns of :data:`FEATURES`."""
    pieces = F.transform(F.regexp_extract_all("value", F.lit("([A-Za-z]{3,})"), 1), F.lower)
    values = found.select(F.explode(F.array("core", "before", "after")).alias("value")).where(F.col("value").isNotNull()).distinct()
    runs = values.select("value", F.explode(pieces).alias("piece"))
    words = dictionary(docs, runs, frequent, text)
    known = cut(runs.join(words, "piece").groupBy("value").agg(F.sum(F.length("piece")).alias("covered")))
    of = lambda name: known.select(F.col("value").alias(name), F.col("covered").alias("_" + name))
    share = lambda name: F.coalesce(F.col("_" + name) / F.length(name), F.lit(0.0))
    words = docs.select(F.col(path).cast("string").alias("path"), n_blank_words(F.col(text)).alias("n")).groupBy("path").agg(F.sum("n").alias("words"))
    rates = found.groupBy("path").agg(F.count(F.lit(1)).alias("found")).select(F.col("path").alias("_path"), "found")
    rates = rates.join(words, rates["_path"].eqNullSafe(words["path"])).select("_path", (F.col("found") / F.greatest("words", F.lit(1))).alias("path_rate"))
    rows = found.join(of("core"), "core", "left").join(of("before"), "before", "left").join(of("after"), "after", "left")
    rows = rows.join(rates, rows["path"].eqNullSafe(rates["_path"]), "left").drop("_path")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("core", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    same = F.regexp_replace(classes, r"(.)\1*", "$1")
    return rows.select(
        *found.columns, F.length("core").cast("double").alias("length"), ((F.length(same) - 1) / F.greatest(F.length("core") - 1, F.lit(1))).alias("changes"),
        _share(F.col("core"), "0-9").alias("digits"), _share(F.col("core"), "A-Z").alias("uppers"), _share(F.col("core"), "a-z").alias("lowers"),
        (F.size(F.array_distinct(F.split("core", ""))) / F.length("core")).alias("distinct"), share("core").alias("coverage"), share("before").alias("known_before"), share("after").alias("known_after"),
        _share(F.col("core"), "/").alias("slashes"), F.coalesce("path_rate", F.lit(0.0)).alias("path_rate"), F.col("token").rlike("[=:]").cast("double").alias("assigned"),
        _has_trigger(F.col("before")).alias("word_before"), _has_trigger(F.col("token")).alias("inside"), _has_trigger(F.col("after")).alias("word_after"),
    )


def _check_digit(core: Column) -> Column:
    """Whether a run is a decimal number that ends in a valid check digit (every second digit doubled, from the right)."""
    digits = F.transform(F.split(F.reverse(core), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.when(core.rlike("^[0-9]+$"), F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(False)


def known_label(found: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """``found`` (of :func:`candidates`) with ``label``: 1 or 0 where evidence of one kind is there, else null."""
    places = found.groupBy("core").agg(F.count_distinct(F.xxhash64("before", "after")).alias("_places"))
    rows = found.join(places, "core")
    secret = F.col("core").rlike(FORMATS) | F.col("named")
    other = _check_digit(F.col("core")) | F.col("core").rlike(IDENTIFIERS) | (F.col("_places") >= repeated)
    return rows.withColumn("label", F.when(secret & ~other, 1).when(other & ~secret, 0)).drop("_places")


def fold(core: Column) -> Column:
    """0 or 1, the same for all findings of a value."""
    return F.pmod(F.xxhash64(core, F.lit("fold")), F.lit(2)).cast("int")


def train(labelled: DataFrame, sample: int = SAMPLE, used: list[str] | None = None, trees: int = 30, depth: int = 8, seed: int = 11):
    """Random forest on ``label`` (1 or 0), with both labels weighing alike; None without findings of both labels."""
    rows = labelled.where(F.col("label").isNotNull())
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(n) < 2:
        return None
    draw = F.pmod(F.xxhash64("core", "id", "at", "run"), F.lit(1 << 20)) / float(1 << 20)
    limit = F.when(F.col("label") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, sample / n[0]))
    weight = F.when(F.col("label") == 1, 0.5 / min(sample, n[1])).otherwise(0.5 / min(sample, n[0])) * min(sample, n[0], n[1])
    rows = cut(_vectors(rows.where(draw < limit).withColumn("weight", weight), used or FEATURES).select("features", "weight", F.col("label").cast("double").alias("label")))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(rows)


def _vectors(rows: DataFrame, used: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=used, outputCol="features").transform(rows)


def judge(found: DataFrame, models: list, used: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """``found`` (of :func:`features`, with ``label``) with ``probability``, from the forest ``models[fold]``, and ``is_secret``."""
    parts = []
    for at, model in enumerate(models):
        part = found.where(fold(F.col("core")) == at)
        if model is None:
            parts.append(part.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.5))))
        else:
            scored = model.transform(_vectors(part, used or FEATURES)).drop("rawPrediction", "prediction", "features")
            parts.append(scored.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1))))
    return parts[0].unionByName(parts[1]).withColumn("is_secret", F.col("probability") > least)


def held_out(judged: DataFrame) -> DataFrame:
    """One row ``n, n_secret, precision, recall``: the answers against the labels that their forests did not see. Each value
    counts once, however often it is copied."""
    values = judged.where(F.col("label").isNotNull()).groupBy("core").agg(F.max("label").alias("label"), F.max(F.col("is_secret").cast("int")).alias("said"))
    both = F.sum(F.col("label") * F.col("said"))
    return values.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_secret"), F.try_divide(both, F.sum("said")).alias("precision"), F.try_divide(both, F.sum("label")).alias("recall"))


def scan(docs: DataFrame, findings: DataFrame | None = None, least: int = LEAST, frequent: int = FREQUENT, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate of ``docs`` with its features, ``label``, ``probability`` and ``is_secret``.

    ``findings`` has ``core, label`` rows (reviewed candidates); without it :func:`known_label` labels what it decides."""
    found = cut(candidates(docs, least, doc_id, text, path))
    if findings is None:
        labelled, used = known_label(found), CONTENT
    else:
        labelled, used = found.join(findings.groupBy("core").agg(F.max("label").alias("label")), "core", "left"), FEATURES
    rows = cut(features(labelled, docs, frequent, text, path))
    return judge(rows, [train(rows.where(fold(F.col("core")) != at), sample, used) for at in (0, 1)], used)
