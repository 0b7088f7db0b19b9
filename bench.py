"""Benchmark: headline queries on Spark, one JSON line on stdout.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 1; the median is reported), BENCH_DUCKDB (default 1:
also time the DuckDB oracle of each query on the same files for reference),
BENCH_PIPELINE (default 1: also time the end-to-end pipeline, reported as
``pipeline_sec`` with per-step times; not part of ``value``).
Each query is executed in full with the ``noop`` sink (no collect).
The one-off derivation of the retail tables from the driver's files is timed
separately as ``adapter_sec`` (it stands for the input files a deployment has).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "base_features",
    "frequent_pairs",
    "edges",
    "degree_centrality",
    "pagerank_converged",
    "basket_expansion_score",
    "cross_sell_topn",
    "cross_sell_user_topn",
    "semantic_similarity_features",
    "derived_semantic_features",
    "hybrid_scores",
    "revenue_impact",
    "roc_auc",
    "parse_price_reply",
    "build_category_requests",
    "hash_sample_exact",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from cartwise.plans import registry
    from cartwise.session import delete_stages, local_session
    from cartwise.sources import testdata

    spark = local_session(cpus, shuffle_partitions=int(cpus))
    registry.load_all()
    t0 = time.time()
    testdata.load_retail(spark, sf_dir)
    adapter = time.time() - t0
    # Untimed warm-up: JVM class loading and code generation of the first job.
    registry.QUERIES["scan_tables"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times, errors = {}, {}
    for name in names:
        runs = []
        try:
            for _ in range(repeat):
                t = time.time()
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.time() - t)
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    pipeline = {}
    if os.environ.get("BENCH_PIPELINE", "1") == "1":
        import tempfile

        from cartwise.plans.pipeline import run_pipeline

        t = time.time()
        try:
            res = run_pipeline(spark, testdata.load_retail(spark, sf_dir),
                               out_dir=tempfile.mkdtemp(prefix="cartwise-bench-pipe-"), min_support=2,
                               gbt_params={"maxIter": 50, "maxDepth": 6})
            pipeline = {"pipeline_sec": round(time.time() - t, 3), "pipeline_steps": res["timings"],
                        "pipeline_settings": "all orders mined, support 2, betweenness k=1000, GBT 50 rounds depth 6"}
        except Exception as e:  # noqa: BLE001
            pipeline = {"pipeline_error": f"{type(e).__name__}: {str(e)[:200]}"}
    delete_stages(spark)
    spark.stop()

    duck = {}
    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        try:
            import duckdb

            con = duckdb.connect()
            for t in ("part", "orders", "lineitem", "embeddings"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
            for name in names:
                if name in registry.ORACLE:
                    t = time.time()
                    con.execute(registry.ORACLE[name]).fetchall()
                    duck[name] = round(time.time() - t, 3)
        except Exception as e:  # noqa: BLE001
            duck["error"] = str(e)[:200]

    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
        "adapter_sec": round(adapter, 3),
        "duckdb_oracle_sec": duck,
    }
    out.update(pipeline)
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
