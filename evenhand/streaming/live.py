"""Monitoring on a live decision stream: disparate impact per window, late rows, feedback pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from evenhand.functions.numeric import ratio
from evenhand.plans import defaults
from evenhand.plans.longform import to_long


def stream_group_rates(stream: DataFrame, ts: str, attrs: Sequence[str], pred: str, every: str, delay: str) -> DataFrame:
    """Approval rate per window, attribute and group. State: one row per open window and group."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    long = to_long(timed, attrs, [ts, F.col(pred).cast("int").alias("_y")])
    return long.groupBy(F.window(ts, every), "attribute", "grp").agg(F.count("_y").alias("n"), F.avg("_y").alias("rate"))


def stream_di_trend(
    stream: DataFrame, ts: str, attrs: Sequence[str], pred: str, every: str = "30 days", delay: str = "1 day",
    alert: float = defaults.DISPARATE_IMPACT,
) -> DataFrame:
    """Disparate impact per window and attribute: a second aggregation chained on the group rates.

    Append mode: a window is emitted once the watermark has passed its end.
    """
    groups = stream_group_rates(stream, ts, attrs, pred, every, delay)
    di = groups.groupBy("window", "attribute").agg(
        F.round(ratio(F.min("rate"), F.max("rate")), 4).alias("di"), F.sum("n").alias("n")
    )
    return di.select(F.col("window.start").cast("timestamp_ntz").alias("period"), "attribute", "n", "di", (F.col("di") < alert).alias("alert"))


def stream_feedback_pairs(
    decisions: DataFrame, outcomes: DataFrame, key: str, decided: str, observed: str, min_days: int = 90, max_days: int = 180,
    delay: str = "1 day",
) -> DataFrame:
    """Stream-stream join of decisions with outcomes seen ``min_days`` to ``max_days`` later. The
    time bounds let both sides drop state once the watermarks are past them."""
    d = decisions.withColumn(decided, F.col(decided).cast("timestamp")).withWatermark(decided, delay)
    o = outcomes.withColumn(observed, F.col(observed).cast("timestamp")).withWatermark(observed, delay).withColumnRenamed(key, "_key")
    near: Column = (
        (F.col(key) == F.col("_key"))
        & (F.col(observed) >= F.col(decided) + F.expr(f"INTERVAL {min_days} DAYS"))
        & (F.col(observed) <= F.col(decided) + F.expr(f"INTERVAL {max_days} DAYS"))
    )
    return d.join(o, near).drop("_key")


def stream_feedback_moments(
    decisions: DataFrame, outcomes: DataFrame, key: str, decided: str, observed: str, pred: str, attrs: Sequence[str], outcome: str = "outcome",
    min_days: int = 90, max_days: int = 180, delay: str = "1 day", every: str = "30 days",
) -> DataFrame:
    """Feedback moments on the live streams, per window of the decision, attribute and group.

    A left outer stream-stream join keeps a decision until no outcome can come any more (``max_days`` and the outcomes' watermark),
    and lets it go without one then; an aggregation chained on it closes each window once all its decisions are through. Both
    states end with the watermarks. ``n_open`` counts decisions that never had an outcome; outcomes behind the watermark
    are dropped and counted by Spark (:func:`late_rows`). Windows add up: see :func:`feedback_of_moments`.
    """
    d = decisions.withColumn(decided, F.col(decided).cast("timestamp")).withWatermark(decided, delay)
    o = outcomes.select(F.col(key).alias("_key"), F.col(observed).cast("timestamp").alias("_seen"), F.col(outcome).cast("double").alias("_o")).withWatermark("_seen", delay)
    near = (
        (F.col(key) == F.col("_key")) & (F.col("_seen") >= F.col(decided) + F.expr(f"INTERVAL {min_days} DAYS"))
        & (F.col("_seen") < F.col(decided) + F.expr(f"INTERVAL {max_days + 1} DAYS"))
    )
    long = to_long(d.join(o, near, "left_outer"), attrs, [decided, F.col(pred).cast("double").alias("_p"), "_o"])
    p = F.when(F.col("_o").isNotNull(), F.col("_p"))
    return long.groupBy(F.window(decided, every), "attribute", "grp").agg(
        F.count("_o").alias("n"), F.count_if(F.col("_o").isNull()).alias("n_open"), F.sum(p).alias("p"), F.sum("_o").alias("o"),
        F.sum(p * p).alias("pp"), F.sum(F.col("_o") * F.col("_o")).alias("oo"), F.sum(p * F.col("_o")).alias("po"),
        F.sum(F.when(p == 0, F.col("_o"))).alias("o0"), F.count(F.when(p == 0, F.col("_o"))).alias("n0"),
        F.sum(F.when(p == 1, F.col("_o"))).alias("o1"), F.count(F.when(p == 1, F.col("_o"))).alias("n1"),
    )


def feedback_of_moments(moments: DataFrame, limit: float = 0.1) -> DataFrame:
    """The feedback loop of all windows emitted so far, as the batch operator states it."""
    names = ["n", "p", "o", "pp", "oo", "po", "o0", "n0", "o1", "n1"]
    m = moments.groupBy("attribute", "grp").agg(*[F.sum(c).alias(c) for c in names]).filter("n > 0")
    spread = lambda a, b: F.col("n") * F.col(a) - F.col(b) * F.col(b)
    r = F.try_divide(F.col("n") * F.col("po") - F.col("p") * F.col("o"), F.sqrt(spread("pp", "p")) * F.sqrt(spread("oo", "o")))
    return m.select(
        "attribute", "grp", "n", F.round(r, 4).alias("r"), F.round(F.try_divide("o0", "n0"), 4).alias("rejected_success"),
        F.round(F.try_divide("o1", "n1"), 4).alias("approved_success"), F.coalesce(F.round(r, 4) > limit, F.lit(False)).alias("active"),
    )


#: State in RocksDB on the executors' disks, with a bound on its memory; Spark's default keeps all of it in their heaps.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def append_to(result: DataFrame, path: str, checkpoint: str, on_disk: bool = False) -> StreamingQuery:
    """Append a streaming result to a parquet table; both paths belong on shared storage. Processes
    everything available and stops, so it also serves scheduled runs. ``on_disk`` is for state that may be larger than the
    executors' memory; a state store that the session names is left as it is."""
    conf = result.sparkSession.conf
    said = dict(conf.getAll)
    held = ON_DISK if on_disk and next(iter(ON_DISK)) not in said else {}
    try:  # a query keeps the settings it is started with
        for k, v in held.items():
            conf.set(k, v)
        return (
            result.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for k in held:
            conf.set(k, said[k]) if k in said else conf.unset(k)


def with_open_windows(emitted: DataFrame, whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The emitted windows and those the watermark has not closed yet, the latter from ``whole``: the same
    operator over the stream's rows as a batch. For the end of a stream, or a look at open windows."""
    return emitted.unionByName(whole.join(emitted.select(*keys), list(keys), "left_anti"))


def late_rows(query: StreamingQuery) -> int:
    """Rows a query left out because they came after the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
