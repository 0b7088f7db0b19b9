import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cartwise.operators import enrich
from cartwise.sources import sinks
from cartwise.streaming.replies import ingest_price_replies


def test_append_is_idempotent_by_key(spark):
    d = tempfile.mkdtemp(prefix="cartwise-sink-")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "product_id bigint, price double")
    sinks.append_table(df, f"{d}/t", key="product_id")
    sinks.append_table(df, f"{d}/t", key="product_id")
    assert spark.read.parquet(f"{d}/t").count() == 2


def test_csv_append_is_idempotent_and_errors_rise(spark):
    d = tempfile.mkdtemp(prefix="cartwise-sink-")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0)], "product_id bigint, price double")
    sinks.append_table(df, f"{d}/t", fmt="csv", key="product_id")
    sinks.append_table(df, f"{d}/t", fmt="csv", key="product_id")
    assert spark.read.option("header", True).csv(f"{d}/t").count() == 2
    os.makedirs(f"{d}/bad")
    with open(f"{d}/bad/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        sinks.append_table(df, f"{d}/bad", key="product_id")


def test_reply_stream_resumes(spark):
    d = tempfile.mkdtemp(prefix="cartwise-stream-")
    products = spark.range(1, 8).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"))
    members, _ = enrich.price_requests(products, batch_size=5)
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.json", "w") as f:
        f.write(json.dumps({"batch_id": 0, "kind": "price", "reply": "1. 1\n2. 2\n3. 3\n4. 4\n5. 5"}) + "\n")
    ingest_price_replies(spark, f"{d}/in", members, f"{d}/out", checkpoint=f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").count() == 5
    with open(f"{d}/in/b.json", "w") as f:
        f.write(json.dumps({"batch_id": 1, "kind": "price", "reply": "1. $6\n2. 7"}) + "\n")
    ingest_price_replies(spark, f"{d}/in", members, f"{d}/out", checkpoint=f"{d}/ckpt")
    out = {r.product_id: r.price for r in spark.read.parquet(f"{d}/out").collect()}
    assert len(out) == 7 and out[6] == 6.0


def test_reply_stream_into_a_store(spark):
    from cartwise.sources.done_store import DoneStore

    d = tempfile.mkdtemp(prefix="cartwise-stream-")
    products = spark.range(1, 8).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"))
    members, _ = enrich.price_requests(products, batch_size=5)
    store = DoneStore(spark, f"{d}/store", spark.createDataFrame([], "product_id long, price double").schema)
    os.makedirs(f"{d}/in")
    for name, record in (("a", {"batch_id": 0, "kind": "price", "reply": "1. 1\n2. 2\n3. 3\n4. 4\n5. 5"}),
                         ("b", {"batch_id": 1, "kind": "price", "reply": "1. $6\n2. 7"})):
        with open(f"{d}/in/{name}.json", "w") as f:
            f.write(json.dumps(record) + "\n")
        ingest_price_replies(spark, f"{d}/in", members, "", checkpoint=f"{d}/ckpt", store=store)
    assert [c.batch for c in store.commits()] == ["replies-0", "replies-1"]
    assert {r.product_id: r.price for r in store.read().collect()}[6] == 6.0
    assert store.pending(products).count() == 0
