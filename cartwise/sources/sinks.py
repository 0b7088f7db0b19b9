"""Sinks (B1-B5): append, overwrite, JSON results, metric lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.sources.files import _exists


def append_table(df: DataFrame, path: str, fmt: str = "parquet", key: str | None = None) -> None:
    """Append a batch (B1).  With ``key``, rows whose key is already stored are skipped and
    one row per key is taken, so a replayed batch adds nothing (idempotent resume).

    Stored rows are read with the schema of ``df``; a table that is there but
    cannot be read raises.
    """
    spark = df.sparkSession
    if key is not None:
        df = df.dropDuplicates([key])
        if _exists(spark, path):
            reader = spark.read.schema(df.schema).format(fmt)
            if fmt == "csv":
                reader = reader.option("header", True).option("mode", "FAILFAST")
            df = df.join(reader.load(path).select(key), key, "left_anti").select(*df.columns)
    writer = df.write.mode("append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table (B2)."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_results_json(doc: DataFrame, path: str) -> None:
    """Nested result record(s) as JSON lines (B3); ``doc`` holds structs, no driver-side conversion."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def write_metric_lines(metrics: DataFrame, path: str, name_col: str = "model", value_col: str = "accuracy") -> None:
    """'<name> Accuracy: 0.1234' text lines."""
    line = F.format_string("%s Accuracy: %.4f", F.col(name_col), F.col(value_col))
    metrics.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)
