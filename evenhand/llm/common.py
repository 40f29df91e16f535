"""Helpers shared by the operators of this subpackage: keys, word rules, shared checkpoints, distributed prefix sums."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The word rules of the query contracts. Blank-separated words, and words of ASCII letters, digits and non-ASCII.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)  # stands for a null id, so ids order and join like any other


def shared_dir(spark: SparkSession) -> None:
    """Make sure checkpoints go to the folder all executors share: the one in ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder; any other master is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evenhand-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: lineage ends in the shared folder, a lost executor loses nothing.
    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Pure ASCII takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (letters, digits and non-ASCII, lower-cased); null text has none."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), NOT_WORD), "")


def n_blank_words(text: Column) -> Column:
    """Number of blank-separated words; null has none. Never null by its type, so that no filter on it is inferred, which
    would count the words once more."""
    pieces = F.split(F.coalesce(text, F.lit("")), BLANKS)
    ends = (F.get(pieces, F.lit(0)) == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return F.coalesce((F.size(pieces) - ends).cast("bigint"), F.lit(0).cast("bigint"))


def text_key(text: Column) -> Column:
    """128-bit key of a text's content; null is its own value."""
    return F.coalesce(F.md5(text), F.lit(""))


def id_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID))


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row`` (a struct of all columns), ``id`` and ``h``: helper columns added to this clash with none of the table's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), id_key(docs[doc_id]).alias("id"), text_key(docs[text]).alias("h"))


def unpacked(rows: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of the table again, some replaced."""
    return [replaced[c].alias(c) if c in replaced else rows["row"][c].alias(c) for c in columns]


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the columns ``names``."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Adds ``before_<v>``: the sum of ``v`` over all rows that sort before this one by ``order``, without a global
    window: rows are range-sorted into pieces, each piece sums its own rows and starts from the totals of the pieces before.

    ``order`` has to tell rows apart (equal rows meet in one piece). What is broadcast has one row per piece.
    """
    pieces = cut(df.repartitionByRange(tasks(df), *order).withColumn("_piece", F.spark_partition_id()))
    ahead = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.groupBy("_piece").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select("_piece", *[F.coalesce(F.sum(f"_sum_{v}").over(ahead), F.lit(0)).alias(f"_start_{v}") for v in values])
    )
    within = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{v}") for v in values])
        .join(F.broadcast(starts), "_piece")
        .select(*df.columns, *[(F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])
    )


def blocks(df: DataFrame, key: str, size: Column, most: int) -> list[DataFrame]:
    """``df`` in parts of about ``most`` bytes (``size`` gives a row's), each fit to be broadcast. One part if all fits;
    otherwise rows are dealt by a hash of ``key``, and the caller takes one pass for each part."""
    total = df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]
    n = -(-total // most) or 1
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
