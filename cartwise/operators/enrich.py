"""Product enrichment as resumable request / reply jobs.

The remote model call of the reference is not part of Spark; the process
boundary is a table on each side.  The request job numbers pending products,
cuts them into batches and writes one request text per batch; the reply job
parses reply texts back onto (batch_id, pos) and appends the result, so a
rerun only sees what is still pending (key-based, ``left_anti``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.session import by_range

# Request texts of the three enrichment kinds.
PRICE_PROMPT = (
    "You are an e-commerce expert. Estimate the price in USD for each product below. "
    "Return only a numbered list of prices, one per line, no explanations. Products:\n"
)
CATEGORY_PROMPT_HEAD = (
    "As a grocery retail expert, categorize these products into semantic categories that represent "
    "shopping behavior. Return ONLY a comma-separated list of categories, one per product:\n\nProducts:\n"
)
ATTRIBUTE_PROMPT = (
    "Product: %s\nDepartment: %s\nAisle: %s\n\nExtract these 6 features and return as JSON: premium_score, "
    "necessity_score, impulse_score, cross_sell_score (0-10), is_food (0/1), price (USD)."
)
# The record used when a structured reply cannot be parsed.
DEFAULT_ATTRIBUTES = {"premium_score": 5.0, "necessity_score": 5.0, "impulse_score": 5.0,
                      "cross_sell_score": 5.0, "is_food": 0, "price": 3.99}
# Products per request.
PRICE_BATCH = 500
CATEGORY_BATCH = 20

ATTRIBUTE_SCHEMA = T.StructType([
    T.StructField("premium_score", T.DoubleType()),
    T.StructField("necessity_score", T.DoubleType()),
    T.StructField("impulse_score", T.DoubleType()),
    T.StructField("cross_sell_score", T.DoubleType()),
    T.StructField("is_food", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
])


def pending(items: DataFrame, done: DataFrame | None, key: str = "product_id") -> DataFrame:
    """Items without a row in ``done`` (A4, D12): resume by key, not by row count."""
    if done is None:
        return items
    return items.join(done.select(key).distinct(), key, "left_anti")


def number_rows(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Adds ``rn`` = 1-based rank of a unique ``key``, without a global window.

    Rows lie in ranges of about equal size (``by_range``); range sizes are
    prefix-summed over that small table, and each range numbers its own rows.
    """
    b = by_range(df, key, name="_bk")
    sizes = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(
        "_bk",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_bk").orderBy(key)
    return b.join(offs, "_bk").withColumn("rn", F.col("_off") + F.row_number().over(w)).drop("_bk", "_off")


def assign_batches(df: DataFrame, size: int, key: str = "product_id") -> DataFrame:
    """batch_id = (rn - 1) div size, pos = 1-based position inside the batch."""
    n = number_rows(df, key)
    return n.withColumns(
        {"batch_id": F.floor((F.col("rn") - 1) / size).cast("long"), "pos": ((F.col("rn") - 1) % size + 1).cast("int")}
    ).drop("rn")


def _batched_text(members: DataFrame, line, sep: str, head: str, tail: str = "") -> DataFrame:
    items = members.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "product_id", "product_name"))).alias("items")
    )
    return items.select(
        "batch_id",
        F.size("items").alias("n_items"),
        F.col("items")[0]["product_id"].alias("first_product_id"),
        F.element_at("items", -1)["product_id"].alias("last_product_id"),
        F.concat(F.lit(head), F.array_join(F.transform("items", line), sep), F.lit(tail)).alias("request"),
    )


def price_requests(products: DataFrame, done: DataFrame | None = None, batch_size: int = PRICE_BATCH):
    """M1 request job: (members, requests).  One numbered list of names per batch.

    A batch holds at most ``batch_size`` items, so collecting it is bounded.
    """
    members = assign_batches(pending(products.select("product_id", "product_name"), done), batch_size)
    line = lambda x: F.concat(x["pos"].cast("string"), F.lit(". "), x["product_name"])
    return members, _batched_text(members, line, "\n", PRICE_PROMPT)


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_price_line(line):
    """Text after the first '.', stripped, '$' and ',' removed; a number or 0.0.

    A line without the "N." prefix loses its integer part ("3.99" -> 99),
    as in the reference.
    """
    rest = _strip(F.regexp_replace(line, r"^[^.]*\.", ""))
    clean = F.replace(F.replace(rest, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    numeric = clean.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    return F.when(numeric, clean.cast("double")).otherwise(F.lit(0.0))


def one_reply(replies: DataFrame) -> DataFrame:
    """One reply per batch: that with the most lines and commas, then the greatest text."""
    parts = F.regexp_count(F.col("reply"), F.lit("[\\n,]"))
    best = replies.groupBy("batch_id").agg(F.max(F.struct(parts.alias("parts"), "reply")).alias("best"))
    return best.select("batch_id", F.col("best.reply").alias("reply"))


def parse_price_replies(replies: DataFrame, members: DataFrame) -> DataFrame:
    """M1 reply job: line ``pos`` of a batch reply prices member ``pos``.

    Missing lines give NULL prices (such members stay pending, see
    ``priced``), extra lines are dropped, repeated replies count once
    (``one_reply``); a batch without a reply yields no rows.
    """
    replies = one_reply(replies)
    lines = replies.select("batch_id", F.posexplode(F.split(_strip(F.col("reply")), "\n")).alias("i", "line"))
    parsed = lines.select("batch_id", (F.col("i") + 1).cast("int").alias("pos"),
                          parse_price_line(F.col("line")).alias("price"))
    got = members.join(replies.select("batch_id"), "batch_id", "left_semi")
    return got.join(parsed, ["batch_id", "pos"], "left").select("product_id", "product_name", "batch_id", "pos",
                                                                 "price")


def priced(parsed: DataFrame) -> DataFrame:
    """The parsed rows that are done; a member without a price is asked for again."""
    return parsed.where(F.col("price").isNotNull())


def top_products(lines: DataFrame, n: int = 200, by: str = "id") -> DataFrame:
    """``n`` products with order lines; ``by='id'`` = smallest ids (reference parity), ``'count'`` = most lines."""
    counts = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_lines"))
    order = ["product_id"] if by == "id" else [F.desc("n_lines"), "product_id"]
    return counts.orderBy(*order).limit(int(n))


def category_requests(products: DataFrame, selected: DataFrame | None = None, batch_size: int = CATEGORY_BATCH):
    """M2 request job, 20 names per batch joined by '; ': all products, or the selected ones (C7 semi join)."""
    chosen = products.select("product_id", "product_name")
    if selected is not None:
        chosen = chosen.join(selected.select("product_id"), "product_id", "left_semi")
    members = assign_batches(chosen, batch_size)
    return members, _batched_text(members, lambda x: x["product_name"], "; ", CATEGORY_PROMPT_HEAD)


def parse_category_replies(replies: DataFrame, members: DataFrame) -> DataFrame:
    """M2 reply job: trimmed comma part ``pos`` is the category of member ``pos``.

    Extra parts are ignored; members beyond a short reply get no row; repeated
    replies count once (``one_reply``).
    """
    replies = one_reply(replies)
    parts = replies.select(
        "batch_id", F.posexplode(F.transform(F.split(_strip(F.col("reply")), ","), lambda x: _strip(x))).alias(
            "i", "llm_category")
    )
    parts = parts.select("batch_id", (F.col("i") + 1).cast("int").alias("pos"), "llm_category")
    return members.join(parts, ["batch_id", "pos"]).select("product_id", "llm_category")


def attribute_requests(products: DataFrame, departments: DataFrame, aisles: DataFrame) -> DataFrame:
    """M3 request job: one prompt per distinct (product, name, department, aisle)."""
    p = (
        products.join(departments, "department_id", "left")
        .join(aisles, "aisle_id", "left")
        .select("product_id", "product_name", "department", "aisle")
        .dropDuplicates()
    )
    return p.withColumn(
        "request",
        F.format_string(ATTRIBUTE_PROMPT, F.col("product_name"), F.col("department"), F.col("aisle")),
    )


def parse_attribute_replies(replies: DataFrame) -> DataFrame:
    """M3 reply job: JSON -> six typed fields; a reply missing any field gets the default record.

    Of repeated replies to a product a complete one counts, then the greatest text.
    """
    parsed = replies.withColumn("j", F.from_json("reply", ATTRIBUTE_SCHEMA, {"mode": "PERMISSIVE"}))
    ok = F.col("j").isNotNull()
    for f in ATTRIBUTE_SCHEMA.fieldNames():
        ok = ok & F.col(f"j.{f}").isNotNull()
    parsed = parsed.select("product_id", "reply", "j", ok.alias("ok")).groupBy("product_id").agg(
        F.max_by(F.struct("j", "ok"), F.struct("ok", "reply")).alias("best")).select("product_id", "best.*")
    ok = F.col("ok")
    cols = [
        F.when(ok, F.col(f"j.{f}")).otherwise(F.lit(v).cast(ATTRIBUTE_SCHEMA[f].dataType)).alias(f)
        for f, v in DEFAULT_ATTRIBUTES.items()
    ]
    return parsed.select("product_id", *cols, (~ok).alias("is_default"))
