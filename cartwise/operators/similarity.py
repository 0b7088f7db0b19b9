"""Embedding similarity of co-purchased products (M6: D13, J13, E6) and text vectors (M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.expr import cosine, l2norm


def with_norms(embeddings: DataFrame) -> DataFrame:
    """product_id, embedding, norm: the norm is computed once per product."""
    return embeddings.select("product_id", "embedding", l2norm("embedding").alias("norm"))


def pair_similarity(pairs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Cosine similarity of both members of each pair; pairs lacking a vector drop out."""
    e = with_norms(embeddings)
    e1 = e.select(F.col("product_id").alias("p1"), F.col("embedding").alias("e1"), F.col("norm").alias("n1"))
    e2 = e.select(F.col("product_id").alias("p2"), F.col("embedding").alias("e2"), F.col("norm").alias("n2"))
    return (
        pairs.select("p1", "p2", "cnt")
        .join(e1, "p1")
        .join(e2, "p2")
        .select("p1", "p2", "cnt", cosine("e1", "e2", "n1", "n2").alias("similarity"))
    )


def similarity_features(pair_sims: DataFrame) -> DataFrame:
    """Per product, over the pairs it is in, count-weighted.

    avg = sum(c s) / sum(c), max = max s, diversity = population std of the
    count-repeated list = sqrt(sum(c (s - avg)^2) / sum(c)) (two passes, stable).
    Both directions of a pair count for each end, as in the reference loop.
    """
    ends = pair_sims.select(F.col("p1").alias("product_id"), "cnt", "similarity").unionByName(
        pair_sims.select(F.col("p2").alias("product_id"), "cnt", "similarity")
    )
    first = ends.groupBy("product_id").agg(
        (F.sum(F.col("cnt") * F.col("similarity")) / F.sum("cnt")).alias("avg_semantic_similarity"),
        F.max("similarity").alias("max_semantic_similarity"),
        F.sum("cnt").alias("_w"),
    )
    spread = (
        ends.join(first.select("product_id", "avg_semantic_similarity", "_w"), "product_id")
        .groupBy("product_id", "_w")
        .agg(
            F.sum(F.col("cnt") * F.pow(F.col("similarity") - F.col("avg_semantic_similarity"), 2)).alias("_ss")
        )
        .select("product_id", F.sqrt(F.col("_ss") / F.col("_w")).alias("semantic_diversity"))
    )
    return first.drop("_w").join(spread, "product_id")


def text_vectors(product_text: DataFrame, num_features: int = 384) -> DataFrame:
    """Spark-native product text vectors over the combined text (M5 alternative).

    RegexTokenizer -> HashingTF(num_features) -> IDF -> L2 Normalizer; returns
    product_id and ``embedding`` as array<float>, the same shape as the input
    embedding table.  (The reference's neural encoder is a single-machine
    library; its vectors arrive as the embeddings table.)
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    text = product_text.where(F.col("combined_text").isNotNull())
    pipe = Pipeline(
        stages=[
            RegexTokenizer(inputCol="combined_text", outputCol="tokens", pattern="\\W+", toLowercase=True),
            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
            IDF(inputCol="tf", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="vec", p=2.0),
        ]
    )
    model = pipe.fit(text)
    return model.transform(text).select("product_id", vector_to_array("vec", "float32").alias("embedding"))
