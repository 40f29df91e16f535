"""The stream gives what the batch gives, and rows behind the watermark are left out and counted."""

import datetime as dt

from pyspark.sql import functions as F

from evenhand.operators import monitoring as N
from evenhand.sources import tables as IO
from evenhand.streaming import live

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "record_id long, ts timestamp_ntz, grp string, approved int"


def write_batches(spark, batches):
    path = IO.scratch_folder(spark, "source")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def decisions(day, hour=12, n=20):
    return [(day * 1000 + i, DAY + dt.timedelta(days=day, hours=hour), "a" if i % 2 else "b", int(i % 4 != 0)) for i in range(n)]


def run(spark, path, state, out):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = live.append_to(live.stream_di_trend(source, "ts", ["grp"], "approved", "1 day", "6 hours"), out, state)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_late_rows_are_counted(spark):
    batches = [decisions(d) for d in range(5)]
    path = write_batches(spark, batches)
    state, out = IO.scratch_folder(spark, "state"), IO.scratch_folder(spark, "out")
    run(spark, path, state, out)
    got = {(r["period"], r["attribute"]): r["di"] for r in spark.read.parquet(out).collect()}
    flat = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = {(r["period"].replace(tzinfo=None), r["attribute"]): r["di"] for r in N.di_trend(flat, "ts", ["grp"], "approved", "day").collect()}
    closed = {k: v for k, v in want.items() if k[0] < DAY + dt.timedelta(days=4)}
    assert got == closed and len(got) == 4
    # a late row for a closed day and one that closes the last day
    spark.createDataFrame(decisions(0, n=2), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(decisions(7, n=2), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    query = run(spark, path, state, out)
    again = {(r["period"], r["attribute"]): r["di"] for r in spark.read.parquet(out).collect()}
    assert again == want
    assert live.late_rows(query) > 0


def test_feedback_pairs(spark):
    made = spark.createDataFrame([(i, DAY + dt.timedelta(days=i), i % 2) for i in range(10)], "record_id long, decided_at timestamp_ntz, y_pred int")
    seen = spark.createDataFrame([(i, DAY + dt.timedelta(days=i + (100 if i < 6 else 10)), 1) for i in range(10)], "record_id long, observed_at timestamp_ntz, outcome int")
    paths = [IO.scratch_folder(spark, n) for n in ("made", "seen", "pairs", "state")]
    made.write.parquet(paths[0])
    seen.write.parquet(paths[1])
    pairs = live.stream_feedback_pairs(
        spark.readStream.schema(made.schema).parquet(paths[0]), spark.readStream.schema(seen.schema).parquet(paths[1]), "record_id", "decided_at", "observed_at"
    )
    live.append_to(pairs, paths[2], paths[3]).awaitTermination()
    assert sorted(r["record_id"] for r in spark.read.parquet(paths[2]).collect()) == list(range(6))


def test_live_feedback_equals_batch_and_its_state_ends(spark):
    """Files that advance by 20 days; after the last ones all decisions are through and no state of theirs is left."""
    paths = [IO.scratch_folder(spark, n) for n in ("made", "seen", "moments", "state")]
    schemas = ["record_id long, decided_at timestamp_ntz, y_pred int, grp string", "record_id long, observed_at timestamp_ntz, outcome int"]
    made, seen = [], []
    for i in range(240):
        made.append((i, DAY + dt.timedelta(days=i), int(i % 3 > 0), "ab"[i % 2]))
        if i % 5:  # every fifth decision never has an outcome; some come too early, some twice
            seen.append((i, DAY + dt.timedelta(days=i + (100 if i % 7 else 30)), int((i * 7) % 11 > 4)))
        if i % 10 == 1:
            seen.append((i, DAY + dt.timedelta(days=i + 170), 1))
    end = DAY + dt.timedelta(days=900)
    made_end, seen_end = [(9000, end, 1, "z")], [(9000, end + dt.timedelta(days=700), 1)]
    for path, schema, rows, when, last in ((paths[0], schemas[0], made, 1, made_end), (paths[1], schemas[1], seen, 1, seen_end)):
        for k in range(0, 430, 20):
            part = [r for r in rows if DAY + dt.timedelta(days=k) <= r[when] < DAY + dt.timedelta(days=k + 20)]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        spark.createDataFrame(last, schema).coalesce(1).write.mode("append").parquet(path)
    read = lambda k: spark.readStream.schema(schemas[k]).option("maxFilesPerTrigger", 4).parquet(paths[k])
    result = live.stream_feedback_moments(read(0), read(1), "record_id", "decided_at", "observed_at", "y_pred", ["grp"])
    query = live.append_to(result, paths[2], paths[3])
    query.awaitTermination()
    rows = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) > 50 and rows[-1] < 10, rows
    found = spark.read.parquet(paths[2])
    want = N.feedback_loop(spark.createDataFrame(made, schemas[0]), spark.createDataFrame(seen, schemas[1]), "record_id", "decided_at", "observed_at", "y_pred", ["grp"])
    assert sorted(map(tuple, live.feedback_of_moments(found).collect())) == sorted(map(tuple, want.collect()))
    pairs = {i for i, t, _ in seen if 90 <= (t - DAY).days - i <= 180}
    assert found.agg(F.sum("n_open")).first()[0] == 240 - len(pairs)


def test_state_on_disk(spark):
    """A join's state in RocksDB, with the rows of the state in memory; the session's settings are as before."""
    rows = [(i, DAY + dt.timedelta(days=i), i % 2, "ab"[i % 2]) for i in range(60)]
    later = [(i, DAY + dt.timedelta(days=i + 100), i % 3 % 2) for i in range(60)]
    rows, later = [*rows, (99, DAY + dt.timedelta(days=900), 1, "z")], [*later, (99, DAY + dt.timedelta(days=1600), 1)]  # all before are through
    paths = [IO.scratch_folder(spark, n) for n in ("made", "seen")]
    schemas = ["record_id long, decided_at timestamp_ntz, y_pred int, grp string", "record_id long, observed_at timestamp_ntz, outcome int"]
    for path, schema, part in zip(paths, schemas, (rows, later)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(path)
    said, found = dict(spark.conf.getAll), []
    for on_disk in (False, True):
        made, seen = (spark.readStream.schema(s).parquet(p) for s, p in zip(schemas, paths))
        result = live.stream_feedback_moments(made, seen, "record_id", "decided_at", "observed_at", "y_pred", ["grp"], every="5 days")
        out = IO.scratch_folder(spark, "moments")
        query = live.append_to(result, out, IO.scratch_folder(spark, "state"), **({"on_disk": True} if on_disk else {}))
        query.awaitTermination()
        metrics = {m for p in query.recentProgress for op in p["stateOperators"] for m in op["customMetrics"]}
        assert any(m.startswith("rocksdb") for m in metrics) == on_disk
        found.append(sorted(map(str, spark.read.parquet(out).collect())))
    assert found[0] == found[1] and len(found[0]) > 0 and dict(spark.conf.getAll) == said


def test_batch_late_report(spark):
    rows = [(DAY + dt.timedelta(hours=h), DAY + dt.timedelta(hours=h + late)) for h, late in ((1, 0), (2, 40), (30, 1), (31, 60))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, arrived timestamp_ntz")
    got = {r["window_start"].day: (r["n"], r["n_late"]) for r in N.late_report(df, "ts", "arrived", "1 day", "12 HOURS").collect()}
    assert got == {1: (2, 1), 2: (2, 1)}
    assert N.late_report(df, "ts", "arrived", "1 day", "90 HOURS").agg(F.sum("n_late")).first()[0] == 0
