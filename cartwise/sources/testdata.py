"""Adapter: the driver's TPC-H-like parquet tables -> the retail star schema.

Mapping (see FIXTURES.md): part -> products, lineitem -> order lines,
orders -> orders with per-user order numbers, customer key -> user.
Everything is derived by Spark from the given tables, so work grows with them.
The same mapping is written in SQL in ``cartwise.plans.oracle`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# p_type -> department_id (alphabetical position).
DEPARTMENT_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# Parts with key % PRICE_GAP == 0 have no price row,
# parts with key % ATTRIBUTE_GAP == 0 have no attribute row.
PRICE_GAP = 17
ATTRIBUTE_GAP = 13


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _department_id(p_type: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for i, t in enumerate(DEPARTMENT_TYPES, start=1):
        expr = expr.when(p_type == t, F.lit(i))
    return expr.cast("int")


def _aisle_id(p_brand: Column) -> Column:
    return F.substring(p_brand, 7, 10).cast("int")


def products(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("bigint").alias("product_id"),
        F.col("p_name").alias("product_name"),
        _aisle_id(F.col("p_brand")).alias("aisle_id"),
        _department_id(F.col("p_type")).alias("department_id"),
    )


def aisles(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(_aisle_id(F.col("p_brand")).alias("aisle_id"), F.col("p_brand").alias("aisle")).distinct()


def departments(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        _department_id(F.col("p_type")).alias("department_id"), F.col("p_type").alias("department")
    ).distinct()


def _numbered_orders(spark, sf_dir) -> DataFrame:
    """Orders, and whether an order is the last one with lines of its user (``is_last``).

    Which orders have lines is known before the orders of a user meet, so one
    shuffle by user serves their numbers, gaps and last orders.
    """
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ordered = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_with_lines")).distinct()
    o = o.join(ordered, F.col("o_orderkey") == F.col("_with_lines"), "left")
    # the user has the name of the result already: a window by another name of it would shuffle the orders once more
    o = o.withColumn("user_id", F.col("o_custkey").cast("bigint"))
    w = Window.partitionBy("user_id").orderBy("o_orderdate", "o_orderkey")
    numbered = o.select(
        F.col("o_orderkey").cast("bigint").alias("order_id"),
        "user_id",
        F.row_number().over(w).cast("int").alias("order_number"),
        (F.dayofweek("o_orderdate") - 1).cast("int").alias("order_dow"),
        (F.col("o_orderkey") % 24).cast("int").alias("order_hour_of_day"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lag("o_orderdate").over(w).cast("date"))
        .cast("double")
        .alias("days_since_prior_order"),
        F.col("_with_lines").isNotNull().alias("_has_lines"),
    )
    last = F.max(F.when(F.col("_has_lines"), F.col("order_number"))).over(Window.partitionBy("user_id"))
    return numbered.withColumn("is_last", F.col("order_number") == last).drop("_has_lines")


ORDER_COLUMNS = ["order_id", "user_id", "order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"]


def orders(spark, sf_dir) -> DataFrame:
    return _numbered_orders(spark, sf_dir).select(*ORDER_COLUMNS)


def _order_lines(spark, sf_dir, numbered: DataFrame | None = None) -> DataFrame:
    """One line per (order, product); the position is the first line number.

    The lines are shuffled twice, to their orders and by (user, product): the
    one key serves the distinct lines and the user's first order of a product.
    ``numbered``: the rows of ``_numbered_orders`` where they have been written.
    """
    if numbered is None:
        numbered = _numbered_orders(spark, sf_dir)
    lines = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("order_id"), F.col("l_partkey").cast("bigint").alias("product_id"),
        "l_linenumber",
    )
    o = numbered.select("order_id", "user_id", "order_number", "is_last")
    lines = lines.join(o, "order_id").where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    lines = lines.repartition("user_id", "product_id")
    lines = lines.groupBy("user_id", "product_id", "order_id", "order_number", "is_last").agg(
        F.min("l_linenumber").cast("int").alias("add_to_cart_order"))
    first = F.min("order_number").over(Window.partitionBy("user_id", "product_id"))
    return lines.select(
        "order_id",
        "product_id",
        "add_to_cart_order",
        (F.col("order_number") > first).cast("int").alias("reordered"),
        F.col("is_last").alias("is_train"),
    )


def order_products(spark, sf_dir, part: str) -> DataFrame:
    """``prior`` or ``train`` lines: the last order of each user is train."""
    lines = _order_lines(spark, sf_dir)
    cond = F.col("is_train") if part == "train" else ~F.col("is_train")
    return lines.where(cond).select("order_id", "product_id", "add_to_cart_order", "reordered")


def product_prices(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.where(F.col("p_partkey") % PRICE_GAP != 0).select(
        F.col("p_partkey").cast("bigint").alias("product_id"), F.col("p_retailprice").cast("double").alias("price")
    )


def product_attributes(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part").where(F.col("p_partkey") % ATTRIBUTE_GAP != 0)
    k = F.col("p_partkey")
    return p.select(
        k.cast("bigint").alias("product_id"),
        (k % 11).cast("double").alias("premium_score"),
        ((k * 3) % 11).cast("double").alias("necessity_score"),
        ((k * 5) % 11).cast("double").alias("impulse_score"),
        ((k * 7) % 11).cast("double").alias("cross_sell_score"),
        (k % 2).cast("int").alias("is_food"),
        F.col("p_retailprice").cast("double").alias("price"),
    )


def product_embeddings(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("product_id"), F.col("embedding"))


def retail_plans(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All retail tables as lazy DataFrames over the driver's parquet files."""
    return {
        "aisles": aisles(spark, sf_dir),
        "departments": departments(spark, sf_dir),
        "products": products(spark, sf_dir),
        "orders": orders(spark, sf_dir),
        "order_products_prior": order_products(spark, sf_dir, "prior"),
        "order_products_train": order_products(spark, sf_dir, "train"),
        "product_prices": product_prices(spark, sf_dir),
        "product_attributes": product_attributes(spark, sf_dir),
        "product_embeddings": product_embeddings(spark, sf_dir),
    }


_MEMO: dict[tuple[str, str], dict[str, DataFrame]] = {}
_INPUTS = ("part", "orders", "lineitem", "embeddings")


def fingerprint(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = _INPUTS) -> str:
    """Identity of the input files by path, name, length and time of change, in whatever store Spark reads."""
    import hashlib

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1(sf_dir.encode())
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        found = fs.listStatus(path)
        for line in sorted(f"{s.getPath().toString()}:{s.getLen()}:{s.getModificationTime()}" for s in found):
            h.update(line.encode())
    return h.hexdigest()[:16]


def load_retail(spark: SparkSession, sf_dir: str, materialize: bool = True) -> dict[str, DataFrame]:
    """Retail tables; by default written once as parquet and read back.

    The written copy lives in the session's reliable checkpoint folder (the
    shared folder named by ``spark.checkpoint.dir``), so it plays the role of
    the input files a real deployment has and later scans get column pruning
    and filter pushdown.  Copy and memo are keyed by the fingerprint of the
    source files, so changed inputs are re-derived.
    """
    if not materialize:
        return retail_plans(spark, sf_dir)
    print_ = fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, print_)
    if key in _MEMO:
        return _MEMO[key]
    from cartwise.session import ensure_checkpoint_dir, shuffle_files_removed

    root = f"{ensure_checkpoint_dir(spark)}/cartwise-retail/{print_}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    plans = retail_plans(spark, sf_dir)
    # prior and train come from one derivation of the lines, and that from the written orders.
    plans.pop("order_products_prior")
    plans.pop("order_products_train")
    plans["orders"] = _numbered_orders(spark, sf_dir)
    plans["order_lines"] = None
    out = {}
    for name, df in plans.items():
        path = f"{root}/{name}"
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not marker.getFileSystem(conf).exists(marker):
            if name == "order_lines":
                df = _order_lines(spark, sf_dir, out["orders"])
            with shuffle_files_removed(spark):
                df.write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    out["orders"] = out["orders"].select(*ORDER_COLUMNS)
    lines = out.pop("order_lines")
    cols = ["order_id", "product_id", "add_to_cart_order", "reordered"]
    out["order_products_prior"] = lines.where(~F.col("is_train")).select(*cols)
    out["order_products_train"] = lines.where(F.col("is_train")).select(*cols)
    _MEMO[key] = out
    return out


# ---- reply tables for the enrichment jobs, derived from the part table ----
# Reply line variants, chosen by product_id % 5:
#   0 "N. $1,234.50" (thousands comma)   1 "N. n/a" (text)   2 "1234.5" (no "N." prefix)
#   3 "N. 1234.5"                         4 "N. $1234.5"
# and every batch with batch_id % 7 == 3 misses its last line.


def price_replies(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("rp"))
    m = members.join(p, "product_id")
    v = F.col("product_id") % 5
    pos = F.col("pos").cast("string")
    rp = F.col("rp").cast("string")
    line = (
        F.when(v == 0, F.concat(pos, F.lit(". $"), F.format_number("rp", 2)))
        .when(v == 1, F.concat(pos, F.lit(". n/a")))
        .when(v == 2, rp)
        .when(v == 3, F.concat(pos, F.lit(". "), rp))
        .otherwise(F.concat(pos, F.lit(". $"), rp))
    )
    last = F.max("pos").over(Window.partitionBy("batch_id"))
    m = m.withColumn("line", line).withColumn("_last", last)
    m = m.where(~((F.col("batch_id") % 7 == 3) & (F.col("pos") == F.col("_last"))))
    return m.groupBy("batch_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]),
                     "\n").alias("reply")
    )


def category_replies(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Category = lower-case type word + '_' + brand number; batch % 5 == 1 gets one extra part,
    batch % 5 == 2 misses its last part."""
    p = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lower("p_type"), F.lit("_"), F.substring("p_brand", 7, 10)).alias("cat"),
    )
    m = members.join(p, "product_id")
    items = m.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cat"))).alias("items"))
    cats = F.transform("items", lambda x: x["cat"])
    cats = (
        F.when(F.col("batch_id") % 5 == 1, F.concat(cats, F.array(F.lit("extra_category"))))
        .when(F.col("batch_id") % 5 == 2, F.slice(cats, 1, F.greatest(F.size(cats) - 1, F.lit(0))))
        .otherwise(cats)
    )
    return items.select("batch_id", F.array_join(cats, ", ").alias("reply"))


def attribute_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of the attribute table; parts without attributes get a broken reply."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("product_id"))
    a = product_attributes(spark, sf_dir)
    j = F.to_json(F.struct("premium_score", "necessity_score", "impulse_score", "cross_sell_score", "is_food",
                           "price"))
    return p.join(a, "product_id", "left").select(
        "product_id",
        F.when(F.col("premium_score").isNotNull(), j).otherwise(F.lit('{"premium_score": ')).alias("reply"),
    )
