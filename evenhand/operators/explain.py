"""Feature attributions per group: which features drive a difference between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evenhand.functions.hashing import uniform
from evenhand.functions.numeric import argmax, argmin, as_double, cap1
from evenhand.operators.models import score_table
from evenhand.plans.longform import require, to_long
from evenhand.sources.tables import written


def _means(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Overall mean of every feature as a scalar subquery (one shared aggregation)."""
    stats = df.agg(*[F.avg(as_double(F.col(f))).alias("m:" + f) for f in features])
    return {f: stats.select("m:" + f).scalar() for f in features}


def linear_phi(df: DataFrame, coefficients: dict[str, float]) -> dict[str, Column]:
    """Exact additive contribution coef * (x - mean x) of every feature to a linear score; a
    missing value contributes nothing."""
    means = _means(df, list(coefficients))
    return {f: F.coalesce(F.lit(float(b)) * (as_double(F.col(f)) - means[f]), F.lit(0.0)) for f, b in coefficients.items()}


def linear_attributions(df: DataFrame, key: str, coefficients: dict[str, float]) -> DataFrame:
    """Long table ``key, feature, phi``."""
    require(df, [key, *coefficients])
    wide = df.select(key, *[c.alias("phi:" + f) for f, c in linear_phi(df, coefficients).items()])
    long = wide.unpivot([key], ["phi:" + f for f in coefficients], "feature", "phi")
    return long.withColumn("feature", F.substring_index("feature", "phi:", -1))


def _mean_phi(long: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    wide = long.groupBy(*by, "attribute", "grp").agg(*[F.avg("phi:" + f).alias("phi:" + f) for f in features])
    out = wide.unpivot([*by, "attribute", "grp"], ["phi:" + f for f in features], "feature", "mean_phi")
    return out.withColumn("feature", F.substring_index("feature", "phi:", -1))


def group_attributions(df: DataFrame, attrs: Sequence[str], coefficients: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Mean contribution per group and feature (unrounded), without writing out the row table."""
    phis = linear_phi(df, coefficients)
    long = to_long(df, attrs, [*by, *[c.alias("phi:" + f) for f, c in phis.items()]])
    return _mean_phi(long, list(coefficients), by)


def attributions_by_group(phi: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The same from any long attribution table that carries the attribute columns."""
    return to_long(phi, attrs, ["feature", "phi"]).groupBy("attribute", "grp", "feature").agg(F.avg("phi").alias("mean_phi"))


def attribution_divergence(means: DataFrame, by: Sequence[str] = (), top: int = 10) -> DataFrame:
    """Spread of the group means per feature; the ``top`` features of every attribute."""
    m = F.col("mean_phi")
    spread = means.groupBy(*by, "attribute", "feature").agg(
        F.round(F.max(m) - F.min(m), 4).alias("divergence"), argmax("grp", m).alias("helps_most"), argmin("grp", m).alias("hurts_most"),
        F.count(F.lit(1)).alias("_groups"),
    )
    order = W.partitionBy(*by, "attribute").orderBy(F.col("divergence").desc(), "feature")
    return spread.filter("_groups >= 2").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("_groups")


def explainability_disparity(divergence: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the five largest divergences, at most 1 (0 without any)."""
    if by:
        order = W.partitionBy(*by).orderBy(F.col("divergence").desc(), "attribute", "feature")
        top = divergence.withColumn("_r", F.row_number().over(order)).filter("_r <= 5")
        return top.groupBy(*by).agg(F.round(cap1(F.avg("divergence")), 4).alias("disparity_score"))
    top = divergence.orderBy(F.col("divergence").desc(), "attribute", "feature").limit(5)
    return top.agg(F.round(cap1(F.coalesce(F.avg("divergence"), F.lit(0.0))), 4).alias("disparity_score"))


def root_cause_ranking(divergence: DataFrame) -> DataFrame:
    """The five strongest drivers per attribute, the first three to be investigated."""
    return divergence.filter("rank <= 5").withColumn("investigate", F.col("rank") <= 3)


def feature_proxy_report(df: DataFrame, proxies: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Features ranked by association with an attribute times mean |contribution|."""
    phis = linear_phi(df, coefficients)
    wide = df.agg(*[F.struct(F.lit(f).alias("feature"), F.avg(F.abs(c)).alias("importance")).alias(f"f{i}") for i, (f, c) in enumerate(phis.items())])
    importance = wide.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(phis))])))
    joined = proxies.join(importance, "feature").withColumn("score", F.round(F.col("cramers_v") * F.col("importance"), 8))
    order = W.partitionBy("attribute").orderBy(F.col("score").desc(), "feature")
    return joined.select("attribute", "feature", "cramers_v", F.round("importance", 6).alias("importance"), "score", F.row_number().over(order).alias("rank"))


def _score(model: PipelineModel | Column, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return score_table(model, df, features) if isinstance(model, PipelineModel) else df.withColumn("y_prob", model)


def _background(df: DataFrame, key: str, features: Sequence[str], rows: int) -> DataFrame:
    """The first ``rows`` rows by the md5 of their key, numbered from 0 (a written table of that many rows at most)."""
    own = df.select(F.coalesce(F.col(key).cast("string"), F.lit("~")).alias("k"), *[as_double(F.col(f)).alias(f"b{i}") for i, f in enumerate(features)])
    names = ["h", "k", *[f"b{i}" for i in range(len(features))]]
    chosen = own.withColumn("h", F.md5(F.concat("k", F.lit("-bg")))).orderBy(*names).limit(rows)
    listed = chosen.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("l")).select(F.posexplode("l").alias("_ref", "s"))
    return written(listed.select("_ref", *[f"s.b{i}" for i in range(len(features))]), "background")


def _contributions(
    df: DataFrame, key: str, features: Sequence[str], model: PipelineModel | Column, attrs: Sequence[str], pairs: tuple[int, int], background: DataFrame,
    n_background: int,
) -> DataFrame:
    """Scored coalitions of every row and drawn pair of orders: ``c0, c1, ...`` add up to each feature's contribution over the pair's
    2d coalitions, ``own`` and ``ref`` to the scores of the row and of its background row.

    A pair is an order of the features and its reverse with one background row, all drawn by a hash of key and pair. Both orders
    start without and end with all features, so these two coalitions are scored once.
    """
    d, f0 = len(features), F.col
    rows = df.select(key, *attrs, *[as_double(F.col(f)).alias(f) for f in features])
    draws = rows.withColumn("_pair", F.explode(F.sequence(F.lit(pairs[0]), F.lit(pairs[1]))))
    tag = F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("~")), F.col("_pair").cast("string"))
    digest = F.concat(*[F.md5(F.concat_ws("-", tag, F.lit(f"o{b}"))) for b in range(-(-d // 8))])  # 16 bits a feature
    draws = draws.withColumn("_d", digest).withColumn("_ref", F.floor(uniform(tag, "b") * n_background).cast("int"))
    slots = F.array(*[F.lit(i) for i in range(d)])
    placed = F.array_sort(F.transform(slots, lambda i: F.struct(F.substring(f0("_d"), i * 4 + 1, F.lit(4)).alias("h"), i.alias("i"))))
    draws = draws.withColumn("_order", F.transform(placed, lambda s: s["i"]))
    draws = draws.withColumns({f"_at{i}": (F.array_position("_order", i) - 1).cast("int") for i in range(d)}).drop("_d", "_order")
    # coalitions: places lo up to hi are the row's own; what they add (p) and take away (m) goes to the features at these places
    steps = [(0, 0, -1, -1, 0, d - 1), (0, d, d - 1, 0, -1, -1)]
    steps += [(0, s, s - 1, -1, s, -1) for s in range(1, d)] + [(d - s, d, d - s, -1, d - s - 1, -1) for s in range(1, d)]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(step, ("_lo", "_hi", "_p", "_q", "_m", "_k"))]) for step in steps])
    # the background has a bounded number of rows
    steps_of = draws.join(F.broadcast(background), "_ref").select("*", F.inline(table))
    inside = lambda i: (f0(f"_at{i}") >= f0("_lo")) & (f0(f"_at{i}") < f0("_hi"))
    at = lambda i, c: (f0(f"_at{i}") == f0(c)).cast("int")
    mixed = steps_of.select(
        key, *attrs, "_pair", "_lo", "_hi", *[(at(i, "_p") + at(i, "_q") - at(i, "_m") - at(i, "_k")).alias(f"_w{i}") for i in range(d)],
        *[F.when(inside(i), F.col(f)).otherwise(F.col(f"b{i}")).alias(f) for i, f in enumerate(features)],
    )
    v = F.col("y_prob")
    return _score(model, mixed, features).select(
        key, *attrs, "_pair", *[(F.col(f"_w{i}") * v / 2).alias(f"c{i}") for i in range(d)],
        F.when(F.col("_hi") - F.col("_lo") == d, v).alias("own"), F.when(F.col("_hi") == 0, v).alias("ref"),
    )


def _prepared(df: DataFrame, key: str, features: Sequence[str], attrs: Sequence[str], background_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The needed columns, written once in even parts (a row becomes many scored ones, so few parts would leave cores
    idle), the background and its number of rows."""
    require(df, [key, *features, *attrs])
    if not features:
        raise ValueError("no features to attribute the score to")
    needed = df.select(*dict.fromkeys([key, *attrs, *features]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(needed.repartition(parts, F.xxhash64(*needed.columns)), "rows")
    background = _background(rows, key, features, background_rows)
    return rows, background, background.count()


def sampled_attributions(
    df: DataFrame, key: str, features: Sequence[str], model: PipelineModel | Column, attrs: Sequence[str] = (), pairs: int = 2,
    background_rows: int = 100,
) -> DataFrame:
    """Monte-Carlo Shapley values ``phi`` of every row's score, by a fitted model's probability or any column expression
    over the features, with the standard error between pairs of orders (null with one pair).

    The sum over the features is the row's score minus the mean score of its drawn background rows. Rows of one key count
    as one row. Costs a shuffle of a row for each row and pair; :func:`group_sampled_attributions` does without.
    """
    df, background, n = _prepared(df, key, features, attrs, background_rows)
    names = [f"c{i}" for i in range(len(features))]
    parts = _contributions(df, key, features, model, attrs, (1, pairs), background, n)
    sums = parts.groupBy(key, *attrs, "_pair").agg(*[F.sum(c).alias(c) for c in names], F.count("own").alias("_n"))
    rows = sums.groupBy(key, *attrs).agg(*[
        F.struct(F.avg(F.col(c) / F.col("_n")).alias("phi"), (F.stddev_samp(F.col(c) / F.col("_n")) / F.sqrt(F.lit(float(pairs)))).alias("std_error")).alias(c) for c in names
    ])
    return rows.select(key, *attrs, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}.phi").alias("phi"), F.col(f"c{i}.std_error").alias("std_error")) for i, f in enumerate(features)])))


def group_sampled_attributions(
    df: DataFrame, key: str, features: Sequence[str], model: PipelineModel | Column, attrs: Sequence[str], tolerance: float = 0.002, pairs: int = 4,
    most_pairs: int = 64, background_rows: int = 100,
) -> DataFrame:
    """Mean Shapley value per group and feature, drawn until every standard error is at most ``tolerance``.

    Each pair of orders gives one estimate of a group's mean over all its rows; their spread is the error of the drawing (rows
    are not drawn, all are used). Pairs are doubled until the largest error is within the tolerance or ``most_pairs`` are
    drawn, then ``settled`` is false. The means of a group add up to ``mean_score - mean_reference``. Sums are formed in the scan
    stage per combination of groups, so no scored row is shuffled; the driver sees the largest error of a round.
    """
    df, background, n_bg = _prepared(df, key, features, attrs, background_rows)
    d, done, rounds = len(features), 0, []
    sums = [*[f"c{i}" for i in range(d)], "own", "ref"]
    while True:
        upto = min(max(2 * done, pairs), most_pairs)
        parts = _contributions(df, key, features, model, attrs, (done + 1, upto), background, n_bg)
        cells = parts.groupBy(*attrs, "_pair").agg(*[F.sum(c).alias(c) for c in sums], F.count("own").alias("n"))
        groups = to_long(cells, attrs, ["_pair", "n", *sums]).groupBy("attribute", "grp", "_pair").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])
        rounds.append(written(groups, "attributions"))
        done = upto
        every = rounds[0]
        for more in rounds[1:]:
            every = every.unionByName(more)
        listed = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"c{i}") / F.col("n")).alias("phi")) for i, f in enumerate(features)])
        long = every.select("attribute", "grp", "n", (F.col("own") / F.col("n")).alias("s"), (F.col("ref") / F.col("n")).alias("r"), F.inline(listed))
        out = long.groupBy("attribute", "grp", "feature").agg(
            F.max("n").alias("n"), F.avg("phi").alias("mean_phi"), (F.stddev_samp("phi") / F.sqrt(F.count("phi"))).alias("std_error"),
            F.avg("s").alias("mean_score"), F.avg("r").alias("mean_reference"),
        )
        worst = out.agg(F.max("std_error").alias("e")).first()["e"]
        if done >= most_pairs or (worst is None and done > 1) or (worst is not None and worst <= tolerance):
            return out.select("*", F.lit(done).alias("pairs"), F.coalesce(F.col("std_error") <= tolerance, F.lit(False)).alias("settled"))
