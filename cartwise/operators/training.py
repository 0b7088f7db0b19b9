"""Model training and comparison with MLlib.

Feature matrices are assembled with ``VectorAssembler`` after NULL -> 0;
models are MLlib's (boosted trees, grown by ``cartwise.operators.boosting``,
stand in for the reference's XGBoost; numeric parity is not a goal).  Metrics are the DataFrame jobs of
``cartwise.operators.evaluation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import SEED, unit_hash
from cartwise.operators import boosting
from cartwise.session import materialize

# Feature lists of the base and the enhanced model.
BASE_FEATURES = [
    "order_hour_of_day", "order_dow", "days_since_prior_order", "aisle_id",
    "department_id", "average_basket_size", "purchase_frequency", "product_reorder_rate",
    "price", "user_avg_order_value", "product_revenue_contribution", "order_recency",
]
ENHANCED_FEATURES = [
    "avg_semantic_similarity", "max_semantic_similarity", "semantic_diversity",
    "degree_centrality", "betweenness_centrality", "pagerank",
    "basket_expansion_score", "cross_sell_strength", "avg_basket_size_with_product",
]
# The reference's boosted-tree settings and random-forest search grid.
GBT_PARAMS = {"maxIter": 200, "maxDepth": 10, "stepSize": 0.1, "seed": SEED}
RF_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, 30],
    "min_samples_split": [2, 5, 10],  # see least_rows
    "minInstancesPerNode": [1, 2, 4],
}


# Labelled rows of a fit: about this many of the smaller class, and of the other one by the class ratio.
LABELLED_ROWS = 4000


def labelled_share(lines: DataFrame, keys: list[str], label: str = "reordered", n: int = LABELLED_ROWS,
                   seed: int = SEED) -> DataFrame:
    """The labelled rows a model is fitted on: those under one hash threshold over both classes.

    The class ratio stays as it is.  The threshold leaves about ``n`` rows of
    the smaller class, or all rows where it has no more.
    """
    rows = lines.where(F.col(label).isin(0, 1))
    fewest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if fewest is None or fewest <= n:
        return rows  # hashes are below 1
    # staged: SMOTE reads them several times, and all lines are hashed once
    return materialize(rows.where(unit_hash(*keys, seed=seed) < F.lit(float(n) / fewest)), "labelled")


# Files of the rows of a large fit.  Of equal size, they are read in equal shares, one a core, in each pass of a fit.
FIT_FILES = 48
# Labelled rows from which dealing them pays.
DEALT_ROWS = 500_000


def in_equal_shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt over FIT_FILES by ``keys`` and sorted: neither the shares of a fit nor its split points hang on how
    the rows were made."""
    return rows.repartition(FIT_FILES, *keys).sortWithinPartitions(*keys, *[c for c in rows.columns if c not in keys])


def dealt_for_fit(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``in_equal_shares`` for the rows of a fit on ``n`` labelled ones; few stay as they are."""
    return rows if n < DEALT_ROWS else in_equal_shares(rows, keys)


def available_features(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """(present, missing) feature names."""
    present = [c for c in wanted if c in df.columns]
    return present, [c for c in wanted if c not in df.columns]


def training_matrix(df: DataFrame, features: list[str], label: str = "reordered") -> DataFrame:
    """Feature columns with NULL -> 0 as double, plus ``label`` (L1, pre-assembly)."""
    present, _ = available_features(df, features)
    keys = [c for c in ("order_id", "product_id") if c in df.columns]
    return df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in present],
                     F.col(label).cast("int").alias("label"))


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def train_gbt(train: DataFrame, features: list[str], **params):
    """Boosted trees, an MLlib model grown over binned rows (L2)."""
    return boosting.fit(train, features, **{**GBT_PARAMS, **params})


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    """prediction (0/1 int) and score = P(label = 1) (L4)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assemble(df, features))
    return out.withColumns(
        {"prediction": F.col("prediction").cast("int"), "score": vector_to_array("probability")[1]}
    ).drop("features", "rawPrediction", "probability")


def evaluate(pred: DataFrame, name: str) -> DataFrame:
    """One row: model, accuracy, auc, n."""
    from cartwise.operators.evaluation import binary_metrics, roc_auc

    acc = binary_metrics(pred).select("accuracy", "n")
    auc = roc_auc(pred)
    return acc.select(F.lit(name).alias("model"), "accuracy", auc.select("auc").scalar().alias("auc"), "n")


def feature_importance(model, features: list[str]) -> DataFrame:
    """feature, importance, category ('enhanced' for graph/semantic features).

    The importance vector has one entry per feature (bounded), so it comes
    from the model object and is turned into a DataFrame.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    vals = model.featureImportances.toArray().tolist()
    return with_category(
        spark.createDataFrame([(f, float(v)) for f, v in zip(features, vals)], "feature string, importance double"))


def with_category(importance: DataFrame) -> DataFrame:
    """Adds the category of each feature."""
    return importance.withColumn(
        "category", F.when(F.col("feature").isin(ENHANCED_FEATURES), F.lit("Enhanced")).otherwise(F.lit("Traditional"))
    )


def class_spread(matrix: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A model-free importance per feature: distance of the class means over the feature's range, with category.

    One aggregate over the rows; 0 where a feature is constant or a class is missing.
    """
    def of(c):
        mean = [F.avg(F.when(F.col(label) == y, F.col(c))) for y in (0, 1)]
        spread = F.try_divide(F.abs(mean[1] - mean[0]), F.max(c) - F.min(c))
        return F.struct(F.lit(c).alias("feature"), F.coalesce(spread, F.lit(0.0)).alias("importance"))

    row = matrix.agg(F.array(*[of(c) for c in features]).alias("all"))
    return with_category(row.select(F.explode("all").alias("f")).select("f.*"))


def importance_by_category(importance: DataFrame) -> DataFrame:
    """Per category: summed importance, share of the total in percent, feature count."""
    total = importance.agg(F.sum("importance")).scalar()
    return importance.groupBy("category").agg(
        F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features")
    ).withColumn("share_pct", F.try_divide(F.col("importance"), total) * 100.0)


def feature_ranking(importance: DataFrame, n: int = 20) -> DataFrame:
    """Top-n features by importance, ties by name."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def model_comparison(base: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Metrics side by side with the improvement in percent."""
    from cartwise.functions.expr import pct_change

    both = base.unionByName(enhanced)
    b = both.agg(
        *[F.max(F.when(F.col("model") == "base", F.col(m))).alias(f"b_{m}") for m in ("accuracy", "auc")],
        *[F.max(F.when(F.col("model") == "enhanced", F.col(m))).alias(f"e_{m}") for m in ("accuracy", "auc")],
    )
    return b.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("base"), F.col(f"e_{m}").alias("enhanced"),
                             pct_change(F.col(f"e_{m}"), F.col(f"b_{m}")).alias("improvement_pct"))
                    for m in ("accuracy", "auc")
                ]
            )
        ).alias("r")
    ).select("r.*")


def least_rows(point: dict) -> int:
    """MLlib's least rows of a child that a grid point stands for.

    A node that may only be split from ``min_samples_split`` rows on is one
    whose children have half of them each, so MLlib's one bound covers both.
    """
    return max(point["minInstancesPerNode"], -(-point["min_samples_split"] // 2))


def choose_param_maps(n_iter: int = 10, seed: int = SEED) -> list[dict]:
    """``n_iter`` of the 81 grid points: those with the smallest hash of their index, no two alike to MLlib."""
    import hashlib
    import itertools

    keys = list(RF_GRID)
    points = [dict(zip(keys, vals)) for vals in itertools.product(*[RF_GRID[k] for k in keys])]

    def h(i: int) -> int:
        return int(hashlib.md5(f"{seed}|grid|{i}".encode()).hexdigest()[:8], 16)

    chosen: dict[tuple, int] = {}
    for i in sorted(range(len(points)), key=lambda i: (h(i), i)):
        chosen.setdefault((points[i]["numTrees"], points[i]["maxDepth"], least_rows(points[i])), i)
    return [points[i] for i in sorted(list(chosen.values())[:n_iter])]


def rf_random_search(train: DataFrame, features: list[str], n_iter: int = 10, folds: int = 3, seed: int = SEED,
                     parallelism: int = 2, scale: dict | None = None):
    """Random forest with a seeded random search and k-fold CV on accuracy.

    ``scale`` may shrink tree counts/depth for tests (e.g. {"numTrees": 0.1}).
    Returns (best model, DataFrame of every candidate with its mean CV accuracy).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator

    spark = train.sparkSession
    # the same forests with less walking: rows keep the node they stand at in each tree
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, cacheNodeIds=True)
    maps, records = [], []
    for p in choose_param_maps(n_iter, seed):
        nt = max(1, int(p["numTrees"] * (scale or {}).get("numTrees", 1.0)))
        md = max(1, min(30, int(p["maxDepth"] * (scale or {}).get("maxDepth", 1.0))))
        maps.append({rf.numTrees: nt, rf.maxDepth: md, rf.minInstancesPerNode: least_rows(p)})
        records.append((nt, md, p["min_samples_split"], p["minInstancesPerNode"]))
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, numFolds=folds, seed=seed, parallelism=parallelism,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"))
    model = cv.fit(assemble(train, features))
    rows = [(*r, float(m)) for r, m in zip(records, model.avgMetrics)]
    table = spark.createDataFrame(
        rows, "num_trees int, max_depth int, min_samples_split int, min_instances_per_node int, cv_accuracy double")
    return model.bestModel, table


def split(df: DataFrame, test_size: float = 0.2, seed: int = SEED,
          keys: tuple[str, ...] = ("order_id", "product_id", "synthetic_no")) -> DataFrame:
    """is_train by hash of the row's keys, NULL ones left out."""
    return df.withColumn("is_train", unit_hash(F.lit("split"), *keys, seed=seed) < F.lit(1.0 - test_size))


def save_model(model, path: str, meta: DataFrame | None = None) -> None:
    """MLlib persistence plus an optional metadata table next to it."""
    model.write().overwrite().save(f"{path}/model")
    if meta is not None:
        meta.write.mode("overwrite").json(f"{path}/meta")
