"""Binary classification metrics as DataFrame jobs.

Inputs are rows with ``label`` (0/1), ``prediction`` (0/1) and/or ``score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import by_range


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """value_counts() and value_counts(normalize=True)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count")).withColumn(
        "share", F.col("count") / total
    )


def binary_metrics(df: DataFrame) -> DataFrame:
    """accuracy and row count."""
    return df.agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact ROC AUC with tie averaging.

    Per distinct score: positives P_s, negatives N_s and the negatives at
    lower scores B_s give AUC = sum P_s (B_s + N_s / 2) / (P N).  The prefix
    sum B_s is distributed: distinct scores lie in ranges of about equal size
    (``by_range``); range totals are prefix-summed over that small table, and
    each range prefix-sums its own distinct scores.
    """
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"),
    )
    per = by_range(per, "s", name="bucket")
    bucket_neg = per.groupBy("bucket").agg(F.sum("neg").alias("bneg"))
    bucket_neg = bucket_neg.withColumn(
        "boff",
        F.coalesce(
            F.sum("bneg").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    w_in = Window.partitionBy("bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.join(bucket_neg.select("bucket", "boff"), "bucket").withColumn(
        "below", F.col("boff") + F.coalesce(F.sum("neg").over(w_in), F.lit(0))
    )
    return ranked.agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)),
            F.sum("pos").cast("double") * F.sum("neg").cast("double"),
        ).alias("auc")
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Rows = true label, columns pred_0 / pred_1."""
    return (
        df.groupBy(F.col("label").cast("int").alias("label"))
        .pivot("prediction", [0, 1])
        .agg(F.count(F.lit(1)))
        .select(
            "label",
            F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"),
            F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1"),
        )
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per class precision / recall / F1 / support, plus macro and weighted averages.

    A ratio with a zero denominator is 0, as the usual report prints it.
    """
    counts = df.agg(
        *[
            F.count_if((F.col("label") == t) & (F.col("prediction") == p)).alias(f"c{t}{p}")
            for t in (0, 1)
            for p in (0, 1)
        ]
    )
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        prec = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(F.struct(F.lit(str(k)).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), (tp + fn).alias("support")))
    per = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    total = F.sum("support")
    avg = per.agg(
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"),
                 F.try_divide(F.sum(F.col("precision") * F.col("support")), total).alias("precision"),
                 F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("recall"),
                 F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("f1"),
                 total.alias("support")).alias("w"),
    )
    extra = avg.select(F.explode(F.array("m", "w")).alias("r")).select("r.*")
    return per.unionByName(extra)
