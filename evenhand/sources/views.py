"""Decision tables derived from the given tables (definitions in FIXTURES.md).

Nothing is hinted: nation and region are broadcast because their files are small, customer is
broadcast or shuffled by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions.hashing import uniform_sql
from evenhand.sources.tables import load

NUMERIC = ["age", "employment_years", "income", "total_price", "branch_tier", "skill_score"]
ATTRS = ["segment", "region", "priority"]
ATTRS4 = [*ATTRS, "balance_sign"]


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as decisions, with planted effects on segment and region."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = o.join(c, F.expr("o_custkey = c_custkey")).join(places, F.expr("c_nationkey = n_nationkey"))
    hit = "c_mktsegment IN ('FURNITURE', 'MACHINERY')"
    penalty = f"(if({hit}, 0.15D, 0D) + if(r_name = 'AFRICA', 0.10D, 0D) + if({hit} AND r_name = 'AFRICA', 0.10D, 0D))"
    score = f"0.30D + 0.40D * {uniform_sql('o_orderkey', 'p')} + 0.20D * least(o_totalprice, 400000D) / 400000D - {penalty}"
    scored = rows.selectExpr(
        "o_orderkey AS record_id",
        "if(o_orderkey % 97 <> 0, c_mktsegment, NULL) AS segment",
        "r_name AS region",
        "o_orderpriority AS priority",
        "if(c_acctbal < 0, 'debit', 'credit') AS balance_sign",
        "cast(if(o_orderkey % 211 = 0, -1, 18 + o_custkey % 50) AS int) AS age",
        "cast(o_orderkey % 60 AS int) AS employment_years",
        "c_acctbal AS income",
        "o_totalprice AS total_price",
        f"cast(least(greatest(if({hit}, 3, 1) + o_orderkey % 3 - 1, 1), 4) AS int) AS branch_tier",
        f"if(o_orderkey % 20 = 0 OR (o_orderkey % 5 = 0 AND {hit}), NULL, round(100 * {uniform_sql('o_orderkey', 's')}, 2)) AS skill_score",
        "o_orderdate AS decided_at",
        f"round(least(greatest({score}, 0.05D), 0.95D), 2) AS y_prob",
        f"{uniform_sql('o_orderkey', 'u')} AS _u",
    )
    return scored.selectExpr("* EXCEPT (_u)", "cast(y_prob >= 0.5D AS int) AS y_pred", "cast(_u < y_prob AS int) AS approved")


def doc_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a partly missing target, skewed languages and 20 small sources."""
    d, lab = load(spark, sf, "documents"), load(spark, sf, "labels")
    return d.select(F.col("doc_id").alias("record_id"), "lang", "source", "n_chars").join(
        lab.select(F.col("doc_id").alias("record_id"), "quality", "toxic"), "record_id", "left"
    )


def small_tables(spark: SparkSession, sf: str) -> DataFrame:
    """2x2 cells per source: long document or not, toxic or not (counts of a few rows)."""
    rows = doc_audit(spark, sf).filter(F.col("toxic").isNotNull())
    return rows.groupBy("source", (F.col("n_chars") > 1000).cast("int").alias("long_text"), "toxic").agg(
        F.count(F.lit(1)).alias("n")
    )


def decision_stream_columns(events: DataFrame) -> DataFrame:
    """Event rows as decisions with an event time; works on batch and streaming input."""
    grp = F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string"))
    return events.select(
        F.col("event_id").alias("record_id"),
        "ts",
        grp.alias("grp"),
        ((F.col("event_type") == "purchase") | ((grp != "g3") & (F.col("event_type") == "click"))).cast("int").alias("approved"),
        "value",
    )


def decision_stream(spark: SparkSession, sf: str) -> DataFrame:
    return decision_stream_columns(load(spark, sf, "events"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Later real-world outcome per decision and shipment: 1 unless the line was returned."""
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        F.col("l_shipdate").alias("observed_at"),
        (F.col("l_returnflag") != "R").cast("int").alias("outcome"),
    )
