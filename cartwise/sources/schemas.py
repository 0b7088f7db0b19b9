"""Explicit schemas of the retail star schema (no inference anywhere)."""

from pyspark.sql import types as T

AISLES = T.StructType([
    T.StructField("aisle_id", T.IntegerType(), False),
    T.StructField("aisle", T.StringType(), True),
])
DEPARTMENTS = T.StructType([
    T.StructField("department_id", T.IntegerType(), False),
    T.StructField("department", T.StringType(), True),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("aisle_id", T.IntegerType(), True),
    T.StructField("department_id", T.IntegerType(), True),
])
ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("order_number", T.IntegerType(), True),
    T.StructField("order_dow", T.IntegerType(), True),
    T.StructField("order_hour_of_day", T.IntegerType(), True),
    T.StructField("days_since_prior_order", T.DoubleType(), True),
])
ORDER_PRODUCTS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("add_to_cart_order", T.IntegerType(), True),
    T.StructField("reordered", T.IntegerType(), True),
])
PRODUCT_PRICES = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("price", T.DoubleType(), True),
])
PRODUCT_ATTRIBUTES = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("premium_score", T.DoubleType(), True),
    T.StructField("necessity_score", T.DoubleType(), True),
    T.StructField("impulse_score", T.DoubleType(), True),
    T.StructField("cross_sell_score", T.DoubleType(), True),
    T.StructField("is_food", T.IntegerType(), True),
    T.StructField("price", T.DoubleType(), True),
])
PRODUCT_EMBEDDINGS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])
REPLIES = T.StructType([
    T.StructField("batch_id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("reply", T.StringType(), True),
])
ATTRIBUTE_REPLIES = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("reply", T.StringType(), True),
])
BASKETS = T.StructType([
    T.StructField("basket_id", T.LongType(), False),
    T.StructField("product_id", T.LongType(), False),
])

# File name -> schema of the six CSV tables plus the price side table.
CSV_TABLES = {
    "aisles": ("aisles.csv", AISLES),
    "departments": ("departments.csv", DEPARTMENTS),
    "orders": ("orders.csv", ORDERS),
    "order_products_prior": ("order_products__prior.csv", ORDER_PRODUCTS),
    "order_products_train": ("order_products__train.csv", ORDER_PRODUCTS),
    "products": ("products.csv", PRODUCTS),
}
PRICE_FILE = "products-with-llm-prices.csv"
