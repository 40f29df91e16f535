"""Reading decision tables, writing result tables, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


# Columns of the given tables. With a schema no job reads file footers to infer one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema: no inference scan over the data.

    A schema ending in ``_corrupt_record string`` keeps unparsable lines visible there.
    """
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", partition: str | None = None) -> None:
    """A result table as JSON lines or parquet, on request one folder per value of a column."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(partition) if partition else writer).save(path)


#: The folder of each running application, by its id.
_RUNS: dict[str, str] = {}


def shared_base(master: str, named: str | None, shared: Callable[[str], bool] = lambda folder: False) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Executors on other machines do not see a local folder, so without the setting only local masters are
    accepted (they then use a temporary folder). A ``file:`` path may be mounted on all machines: with
    another master it is accepted if ``shared`` finds it so.
    """
    local = master.startswith("local")
    if not named and not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if named and not local and named.startswith("file:") and not shared(named):
        raise RuntimeError(f"spark.checkpoint.dir is {named}, which executors on other machines do not see")
    return named or tempfile.mkdtemp(prefix="evenhand-")


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path: the folder may be in any store Spark writes to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def shared_by_all(spark: SparkSession, base: str) -> bool:
    """Whether the driver and the executors there are share a folder: a row is written there by a task for
    every core, and all rows are found again."""
    n = spark.sparkContext.defaultParallelism
    path = f"{base.rstrip('/')}/evenhand-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        return spark.read.schema("id bigint").option("ignoreMissingFiles", True).parquet(path).count() == n
    finally:
        fs, folder = _folder(spark, path)
        fs.delete(folder, True)


def run_folder(spark: SparkSession) -> str:
    """One folder for all intermediate tables of this application; it is deleted by :func:`release`,
    at the latest when the JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        base = shared_base(spark.sparkContext.master, named, lambda folder: shared_by_all(spark, folder))
        path = f"{base.rstrip('/')}/evenhand-{uuid.uuid4().hex}"
        fs, folder = _folder(spark, path)
        fs.deleteOnExit(folder)
        _RUNS[app] = path
    return _RUNS[app]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far. Results that were not written or collected
    before can't be read afterwards."""
    path = _RUNS.pop(spark.sparkContext.applicationId, None)
    if path:
        fs, folder = _folder(spark, path)
        fs.delete(folder, True)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the run's folder."""
    return f"{run_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` from a parquet copy in the shared folder: lineage ends there, and a
    lost executor re-reads files instead of recomputing."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """``n_rows, checksum`` of a table: independent of row order and of partitioning. The checksum adds
    up the first 32 bits of each row's md5 (values as text, nulls marked), so any SQL engine can check it."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def audit_entries(
    metrics: DataFrame, run_id: str, model_version: str, data: DataFrame, mitigation: str, approved_by: str
) -> DataFrame:
    """Typed audit-log rows, one per metric row (``attribute, metric, value``)."""
    fp = fingerprint(data)
    return metrics.select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_version).alias("model_version"),
        fp.select("n_rows").scalar().alias("data_rows"),
        fp.select("checksum").scalar().alias("data_version"),
        F.col("attribute").cast("string").alias("attribute"),
        F.col("metric").cast("string").alias("metric"),
        F.col("value").cast("double").alias("value"),
        F.lit(mitigation).alias("mitigation"),
        F.lit(approved_by).alias("approved_by"),
    )


def append_log(entries: DataFrame, path: str) -> None:
    """Append only: the log is never rewritten. A run leaves one directory per run id, and a link in the chain beside the log
    (:func:`verify_log`) that holds the hash of its entries and of the links before it. A run
    without entries leaves neither."""
    spark = entries.sparkSession
    entries = written(entries, "entries")  # what is hashed is what is logged
    before = [r["hash"] for r in _heads(_links(spark, path)).orderBy("hash").collect()]  # one, but for runs logged side by side
    links = _digests(entries).withColumn("previous", F.array(*map(F.lit, before)).cast("array<string>"))
    links = written(links.withColumn("hash", _link_hash()), "links")
    entries.write.mode("append").partitionBy("run_id").parquet(path)
    links.write.mode("append").parquet(_chain(path))


LINK = "run_id string, n_entries bigint, digest string, previous array<string>, hash string"


def _chain(path: str) -> str:
    return path.rstrip("/") + "-chain"


def _links(spark: SparkSession, path: str) -> DataFrame:
    """The links of a log; none before its first run."""
    fs, folder = _folder(spark, _chain(path))
    return spark.read.schema(LINK).parquet(_chain(path)) if fs.exists(folder) else spark.createDataFrame([], LINK)


def _heads(links: DataFrame) -> DataFrame:
    """Links that no other link follows."""
    followed = links.select(F.explode("previous").alias("hash")).distinct()
    return links.select("hash").distinct().join(followed, "hash", "left_anti")


def _digests(entries: DataFrame) -> DataFrame:
    """``run_id, n_entries, digest``: sums of four 60-bit parts of each entry's sha256, so that neither order nor files matter."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in sorted(entries.columns) if c != "run_id"]
    text = F.concat_ws("|", *[F.concat(F.length(v).cast("string"), v) for v in values])  # lengths: no two rows share a text
    rows = entries.select(F.col("run_id").cast("string").alias("run_id"), F.sha2(text, 256).alias("_h"))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_entries"), F.concat_ws("-", *parts).alias("digest"))


def _link_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.length("run_id").cast("string"), "run_id", F.col("n_entries").cast("string"), "digest", F.concat_ws(",", "previous")), 256)


def verify_log(spark: SparkSession, path: str, heads: Sequence[str] = ()) -> DataFrame:
    """``run_id, n_entries, status`` of every run of a log, of every link that is missed, and of missing ``heads``.

    ``ok``; ``changed``: the entries are not those that were logged; ``lost``: a link without entries; ``unlinked``: entries
    without a link (a run that broke off, or was written past :func:`append_log`); ``forged``: a link that is not what its hash
    says; ``repeated``: a run id with several links; ``missing``: a link that a later one, or one of ``heads``, follows is gone
    (``run_id`` is its hash). Keep :func:`log_heads` elsewhere: without it the loss of the last run with its link goes unseen.

    Runs logged side by side follow the same links; the next run follows them all, so none is lost and the check holds."""
    links = _links(spark, path).withColumn("_right", F.coalesce(_link_hash() == F.col("hash"), F.lit(False)))
    fs, folder = _folder(spark, path)
    if fs.exists(folder):
        # run ids are folder names: read as text, whatever they look like
        log = spark.read.parquet(path)
        schema = ", ".join(f"`{f.name}` {'string' if f.name == 'run_id' else f.dataType.simpleString()}" for f in log.schema)
        found = _digests(spark.read.schema(schema).parquet(path))
    else:
        found = spark.createDataFrame([], "run_id string, n_entries bigint, digest string")
    known = links.groupBy("run_id").agg(F.count(F.lit(1)).alias("_links"), F.min("_right").alias("_right"), F.min("digest").alias("_digest"))
    status = (
        F.when(F.col("_links").isNull(), "unlinked").when(F.col("_links") > 1, "repeated").when(~F.col("_right"), "forged")
        .when(F.col("digest").isNull(), "lost").when(F.col("digest") != F.col("_digest"), "changed").otherwise("ok")
    )
    runs = known.join(found, "run_id", "full").select("run_id", F.coalesce("n_entries", F.lit(0).cast("bigint")).alias("n_entries"), status.alias("status"))
    named = spark.createDataFrame([(h,) for h in heads], "hash string").union(links.select(F.explode("previous"))).distinct()
    missed = named.join(links.select("hash"), "hash", "left_anti")
    return runs.unionByName(missed.select(F.col("hash").alias("run_id"), F.lit(0).cast("bigint").alias("n_entries"), F.lit("missing").alias("status")))


def log_heads(spark: SparkSession, path: str) -> list[str]:
    """The hashes of the last links of a log, to be kept elsewhere: one, but after runs logged side by side."""
    return sorted(r["hash"] for r in _heads(_links(spark, path)).collect())


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column (both mean 'missing')."""
    def fix(name: str, dtype: str) -> Column:
        c = F.col(name)
        return F.when(~F.isnan(c), c).alias(name) if dtype in ("double", "float") else c

    return df.select(*[fix(n, t) for n, t in df.dtypes])
