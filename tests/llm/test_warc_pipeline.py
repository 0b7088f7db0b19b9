import base64
import gzip
import hashlib
import io
import os

import pytest

import corpus_pipeline
from cartwise.llm import decontaminate, queries, simhash, warc

SF = "/root/testdata/sf0.001"


def pages(spark):
    rows = [(5, "http://a/b?c=d e", "<p>hällo</p>"), (2, "http://x", "<p>hällo</p>"), (9, None, None), (7, "u", ""),
            (None, "http://n", "<p>hällo</p>"), (None, "http://m", "only null"), (3, "a\r\nb: c", "x\r\n\r\ny" * 9),
            (2, "http://x", "<p>hällo</p>"), (11, "big", "z" * 3_000_000), (12, "big", "z" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS same")


def test_round_trip(spark):
    rows, df = pages(spark)
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None:
            first[h] = min(first.get(h, i), i)
    expect = []
    for i, _, h in rows:
        h = (h or "").encode()
        to = first.get(h)
        revisit = to is not None and i != to
        expect.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response",
                       to if revisit else None))
    got = [tuple(r) for r in warc.round_trip(df, archive_bytes=1000).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df.where("page_id > 2"), min_bytes=1000).collect()}
    assert small == {5: "response", 9: "response", 7: "response", 3: "response", 11: "response", 12: "revisit"}


def test_files(spark, tmp_path):
    _, df = pages(spark)
    root = f"file://{tmp_path}"
    manifest = warc.write_archives(warc.plan_records(df.coalesce(1)), root)
    members = warc.normalise(manifest, root)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_archives(members).collect() if r["payload"] is not None}
    assert payloads[11] == b"z" * 3_000_000 and payloads[3] == b"x\r\n\r\ny" * 9
    for m in members.collect():
        data = open(m["path"][7:], "rb").read()
        index = [eval(x, {"null": None}) for x in open(m["index_path"][7:])]
        assert sum(e["length"] for e in index) == len(data) and len(index) == m["n_records"]
        for e in index:  # each member is a gzip file of one record
            assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
    mono = [gzip.open(m["path"][7:]).read() for m in manifest.collect()]
    split = [gzip.open(m["path"][7:]).read() for m in members.collect()]
    assert sorted(mono) == sorted(split)


def test_rewrite_edges():
    one = warc.record(1, "u", b"abc", "response", None) + warc.record(2, "u", b"", "revisit", 1)
    for packed in (gzip.compress(one), b"".join(gzip.compress(one[i : i + 50]) for i in range(0, len(one), 50))):
        out = io.BytesIO()
        index = list(warc.rewrite(warc.inflated(io.BytesIO(packed)), out))
        assert [e["type"] for e in index] == ["response", "revisit"] and gzip.decompress(out.getvalue()) == one
    with pytest.raises(ValueError):
        list(warc.rewrite(warc.inflated(io.BytesIO(gzip.compress(one)[:-30])), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.rewrite(iter([one[:-9]]), io.BytesIO()))
    assert list(warc.rewrite(iter([]), io.BytesIO())) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF).cache()
        if k < 4:
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
            rest = simhash.near_duplicates(docs)
            assert rest.where("doc_id <> component_id").count() == 0
        if name == "decontaminate":
            found = decontaminate.contained_items(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert docs.count() == before.count() - found.select("doc_id").distinct().count()
        if name == "secrets":
            assert docs.count() == before.count() and docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("taken > 0").count() == docs.count() > 0


def test_registered_once_each():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert os.path.exists("/opt/tokenizers")
