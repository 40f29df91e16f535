"""Split, train, score and evaluate a decision model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from evenhand.functions.numeric import as_double
from evenhand.plans.longform import to_long
from evenhand.plans.ordered import first_by_hash
from evenhand.plans.quantiles import exact_quantiles
from evenhand.sources.tables import written


def stratified_split(df: DataFrame, key: str, target: str, test_share: float = 0.3, seed: int = 42) -> DataFrame:
    """``split`` = test for exactly floor(share * n) rows of every label, chosen by md5 order of the key
    (rows with equal keys by their other columns)."""
    rows = df.filter(F.col(target).isNotNull())
    chosen = first_by_hash(rows, key, target, lambda n: F.floor(n * test_share), str(seed))
    return chosen.withColumn("split", F.when(F.col("_first"), "test").otherwise("train")).drop("_first")


_FOREST_ROWS = (10_000, 1_000_000)  # least and most rows of a task that grows trees


def fit_classifier(train: DataFrame, features: Sequence[str], target: str, kind: str = "forest", weight: str | None = None,
                   trees: int = 100, depth: int = 14, seed: int = 42, leaves: int = 100_000) -> PipelineModel:
    """Median imputation (exact), assembly and a random forest or logistic regression, fitted on the
    train rows only. ``weight`` names a sample-weight column. Trees grow to ``depth`` (Spark allows 30); a
    leaf keeps at least 1 / ``leaves`` of the rows, which bounds the model however large the table. The rows of a forest are dealt
    to all cores, and keep the node they have come to in each tree."""
    cast = train.select("*", *[as_double(F.col(f)).alias("x:" + f) for f in features])
    filled = ["m:" + f for f in features]
    medians = {f: q[0] if q else 0.0 for f, q in exact_quantiles(train, features, [0.5]).items()}
    fill = ", ".join(f"coalesce(`x:{f}`, {medians[f]!r}D) AS `m:{f}`" for f in features)
    imputer = SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__")
    assemble = VectorAssembler(inputCols=filled, outputCol="features")
    args = {"featuresCol": "features", "labelCol": target}
    if weight:
        args["weightCol"] = weight
    if kind == "forest":
        rows = train.count()
        few, many = _FOREST_ROWS
        pieces = max(min(train.sparkSession.sparkContext.defaultParallelism, rows // few), rows // many)
        cast = cast.repartition(pieces) if pieces > 1 else cast
        least = max(1, rows // leaves)
        learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, maxMemoryInMB=1024, cacheNodeIds=True, **args)
    else:
        learner = LogisticRegression(maxIter=50, regParam=1e-4, **args)
    return Pipeline(stages=[imputer, assemble, learner]).fit(cast)


def score_table(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The table with ``y_pred`` (0/1) and ``y_prob`` (probability of 1) from the model."""
    cast = df.select("*", *[as_double(F.col(f)).alias("x:" + f) for f in features])
    out = model.transform(cast)
    prob = vector_to_array("probability")[1]
    rest = [c for c in df.columns if c not in ("y_pred", "y_prob")]
    return out.select(*rest, F.col("prediction").cast("int").alias("y_pred"), prob.alias("y_prob"))


def train_scores(df: DataFrame, key: str, features: Sequence[str], target: str, kind: str = "forest", **kw) -> DataFrame:
    """Split, fit on the train part and score the test part."""
    parts = written(stratified_split(df, key, target), "split")  # read by every pass of the fit
    model = fit_classifier(parts.filter("split = 'train'"), features, target, kind, **kw)
    return score_table(model, parts.filter("split = 'test'"), features)


def accuracy(df: DataFrame, target: str, pred: str, attrs: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions: per group of every attribute, and over all rows."""
    right = (F.col(target) == F.col(pred)).cast("int").alias("_ok")
    wide = df.select(*attrs, F.lit("all").alias("overall"), right)
    long = to_long(wide, ["overall", *attrs], ["_ok"])
    return long.groupBy("attribute", "grp").agg(F.count("_ok").alias("n"), F.round(F.avg("_ok"), 4).alias("accuracy"))
