"""Registered queries: sources, preprocessing, sampling (A, C, D1-D5, F, H1, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators import prep, sampling
from cartwise.plans.oracle import h, round_cols, sql
from cartwise.plans.registry import once, register, stage, staged
from cartwise.session import stage_folder
from cartwise.sources import files, testdata
from cartwise.streaming import features as stream_features

MERGED_DOUBLES = ["days_since_prior_order", "price"]
FEATURE_DOUBLES = MERGED_DOUBLES + [
    "user_avg_order_value", "user_total_spent", "product_reorder_rate", "product_revenue_contribution",
]


def tables(spark, sf_dir):
    return testdata.load_retail(spark, sf_dir)


PRODUCT_TEXTS = ["product_name", "aisle", "department"]


def merged(spark, sf_dir):
    """Merged order lines, lazy: each query scans the columns it needs."""
    return prep.merge_all(tables(spark, sf_dir))[0]


def imputed(spark, sf_dir):
    """Lines without missing values; the median is looked up once a query."""
    return once("imputed", spark, sf_dir, lambda: prep.impute_missing(merged(spark, sf_dir)))


def thin_merged(spark, sf_dir):
    """Merged order lines without the product texts, lazy, dealt by order."""
    return prep.merge_all(prep.without_texts(tables(spark, sf_dir)))[0]


def thin_lines(spark, sf_dir):
    """Merged lines without the product texts, staged in buckets of their order: for queries that read them several times."""
    return stage("lines", spark, sf_dir, lambda: thin_merged(spark, sf_dir), by="order_id")


def thin_imputed(spark, sf_dir):
    """The staged lines without missing values; the median is looked up once a query."""
    return once("thin-imputed", spark, sf_dir, lambda: prep.impute_missing(thin_lines(spark, sf_dir)))


#: What pairs, basket metrics and scores read of a line, and the imputation.
SCORE_COLUMNS = ["order_id", "product_id", "user_id", "add_to_cart_order", "reordered", "days_since_prior_order", "price"]


def score_lines(spark, sf_dir):
    """The SCORE_COLUMNS of the merged lines, staged in buckets of their order; the whole lines where a query has these."""
    if (lines := staged("lines", spark, sf_dir)) is not None:
        return lines
    return stage("score-lines", spark, sf_dir, lambda: thin_merged(spark, sf_dir).select(*SCORE_COLUMNS), by="order_id")


def score_imputed(spark, sf_dir):
    """``score_lines`` without missing values; the median is looked up once a query."""
    if staged("lines", spark, sf_dir) is not None:
        return thin_imputed(spark, sf_dir)
    return once("score-imputed", spark, sf_dir, lambda: prep.impute_missing(score_lines(spark, sf_dir)))


def features(spark, sf_dir):
    """Lines with base features.  Four aggregates fan out from the lines, so these are staged,
    without the product texts, which are joined to the result."""
    t = tables(spark, sf_dir)
    texts = prep.product_dim(t["products"], t["aisles"], t["departments"]).select("product_id", *PRODUCT_TEXTS)
    return prep.add_base_features(thin_imputed(spark, sf_dir)).join(texts, "product_id")


_RETAIL = ["aisles", "departments", "products", "orders", "order_products_prior", "order_products_train",
           "product_prices", "product_attributes", "product_embeddings"]
_RETAIL_SQL = {"aisles": ("r_aisles", 2), "departments": ("r_departments", 2), "products": ("r_products", 4),
               "orders": ("r_orders", 6), "order_products_prior": ("r_prior", 4),
               "order_products_train": ("r_train", 4), "product_prices": ("r_prices", 2),
               "product_attributes": ("r_attrs", 7), "product_embeddings": ("r_emb", 2)}


@register("scan_tables", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, {c} AS n_columns FROM {t}"
    for n, (t, c) in _RETAIL_SQL.items())))
def q_scan_tables(spark, sf_dir):
    """Row and column count of every retail table."""
    t = tables(spark, sf_dir)
    return files.table_profile({n: t[n] for n in _RETAIL})


@register("product_dim", sql("SELECT * FROM r_product_dim"))
def q_product_dim(spark, sf_dir):
    t = tables(spark, sf_dir)
    return prep.product_dim(t["products"], t["aisles"], t["departments"])


@register("merge_prices", sql("SELECT * FROM r_products_full"))
def q_merge_prices(spark, sf_dir):
    t = tables(spark, sf_dir)
    return prep.attach_prices(prep.product_dim(t["products"], t["aisles"], t["departments"]), t["product_prices"])


@register("order_lines_union", sql("SELECT * FROM r_lines_all"))
def q_order_lines_union(spark, sf_dir):
    t = tables(spark, sf_dir)
    return prep.union_order_lines(t["order_products_prior"], t["order_products_train"])


@register("merged_lines", sql(round_cols("SELECT * FROM r_merged", MERGED_DOUBLES)))
def q_merged_lines(spark, sf_dir):
    return merged(spark, sf_dir)


@register("missing_profile", sql("""
SELECT count_if(days_since_prior_order IS NULL) AS days_since_prior_order_missing,
       count_if(price IS NULL) AS price_missing
FROM r_merged"""))
def q_missing_profile(spark, sf_dir):
    return prep.missing_profile(merged(spark, sf_dir), ["days_since_prior_order", "price"])


@register("impute_missing", sql(round_cols("SELECT * FROM r_imputed", MERGED_DOUBLES)))
def q_impute_missing(spark, sf_dir):
    return imputed(spark, sf_dir)


@register("user_features", sql(round_cols("SELECT * FROM r_user_stats",
                                          ["user_avg_order_value", "user_total_spent"])))
def q_user_features(spark, sf_dir):
    return prep.user_stats(imputed(spark, sf_dir))


@register("product_line_features", sql(round_cols("SELECT * FROM r_product_stats",
                                                  ["product_reorder_rate", "product_revenue_contribution"])))
def q_product_line_features(spark, sf_dir):
    return prep.product_stats(imputed(spark, sf_dir))


@register("recency_features", sql("""
SELECT order_id, product_id, user_id, order_recency, product_last_ordered FROM r_features"""))
def q_recency_features(spark, sf_dir):
    return features(spark, sf_dir).select("order_id", "product_id", "user_id", "order_recency",
                                          "product_last_ordered")


@register("base_features", sql(round_cols("SELECT * FROM r_features", FEATURE_DOUBLES)))
def q_base_features(spark, sf_dir):
    """N1 without the sample: every line with its user/product/recency features."""
    return features(spark, sf_dir)


@register("streamed_features", sql(round_cols(
    f"SELECT * EXCLUDE ({', '.join(PRODUCT_TEXTS)}) FROM r_features", FEATURE_DOUBLES)))
def q_streamed_features(spark, sf_dir):
    """F1-F8 kept by a stream that gets the lines in two parts, some of them twice."""
    # in the order of the merge: of repeated lines the first to arrive counts
    lines = stage("stream-lines", spark, sf_dir, lambda: merged(spark, sf_dir).drop(*PRODUCT_TEXTS)).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("order_id", F.lit(3600))))
    part, folder = F.pmod(F.xxhash64("order_id"), F.lit(4)), stage_folder(spark, "line-stream")
    for mine in (part < 3, part > 1):
        lines.where(mine).write.mode("append").parquet(f"{folder}/in")
        stream_features.ingest_lines(spark, f"{folder}/in", f"{folder}/state", lines.schema)
    return stream_features.current_features(spark, f"{folder}/state")


_KEYS = ["order_id", "product_id"]


@register("hash_sample", sql(f"""
SELECT order_id, product_id, user_id, reordered FROM r_merged WHERE {h('order_id', 'product_id')} < 0.2"""))
def q_hash_sample(spark, sf_dir):
    """20 % of the lines by key hash."""
    m = merged(spark, sf_dir).select("order_id", "product_id", "user_id", "reordered")
    return sampling.hash_sample(m, 0.2, _KEYS)


@register("hash_sample_exact", sql(f"""
SELECT order_id, product_id, user_id, reordered FROM r_merged
QUALIFY row_number() OVER (ORDER BY {h('order_id', 'product_id')}, order_id, product_id)
        <= (SELECT round_even(0.02 * count(*), 0) FROM r_merged)"""))
def q_hash_sample_exact(spark, sf_dir):
    """I1/I2 exact size: round(2 % of n) lines with the smallest key hash."""
    m = merged(spark, sf_dir).select("order_id", "product_id", "user_id", "reordered")
    return sampling.hash_sample_exact(m, _KEYS, fraction=0.02)


@register("train_test_split", sql(f"""
SELECT order_id, product_id, reordered, {h("'split'", 'order_id', 'product_id')} < 0.8 AS is_train
FROM r_merged"""))
def q_train_test_split(spark, sf_dir):
    """80/20 split by hash of the line key."""
    m = merged(spark, sf_dir).select("order_id", "product_id", "reordered")
    return sampling.train_test_split(m, _KEYS, test_size=0.2)


@register("distinct_products", sql("""
SELECT DISTINCT product_id, product_name, department, aisle FROM r_merged"""))
def q_distinct_products(spark, sf_dir):
    """C14: distinct product rows seen in the order lines."""
    return merged(spark, sf_dir).select("product_id", "product_name", "department", "aisle").dropDuplicates()


@register("user_basket", sql("""
SELECT user_id, order_id, product_id, add_to_cart_order FROM r_merged
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY order_number, add_to_cart_order, product_id) <= 3"""))
def q_user_basket(spark, sf_dir):
    """The first three products of every user (all users, not only the first)."""
    from cartwise.operators.recommend import first_items_per_user

    return first_items_per_user(merged(spark, sf_dir), 3)
