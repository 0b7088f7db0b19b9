"""Exact token counts: one length histogram answers every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that belongs to the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Token lengths in one range of the two-level suffix sums.
RANGE = 1024

_ENCODERS: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a rank file's content, built once per worker."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Drop the tokenizers that this worker holds."""
    _ENCODERS.clear()


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and n_tokens, for each row of ``docs``; a null text has no tokens.

    The rank file (under 1 MB, fixed) is read by the driver and shipped in a
    broadcast, so executors need no copy of it.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for b in batches:
            counts = [0 if t is None else len(encode(t)) for t in (x.as_py() for x in b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    rows = docs.select(F.col(text_col).cast("string"), *keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens) per document -> one row per distinct length with running and suffix sums.

    n_docs, tokens: of this length; docs_from, tokens_from: of this length and
    longer; docs_upto: of this length and shorter; truncated: tokens left when
    every document is cut at this length; all_docs, all_tokens: of all.
    Lengths are summed in two levels (ranges of RANGE lengths, then within a
    range), so neither many documents nor many lengths meet in one task.
    No documents give no rows.
    """
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                           F.floor(F.col("n_tokens") / RANGE).alias("length_range"))
    counts = materialize(counts, "token-lengths")
    ranges = counts.groupBy("length_range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy("length_range").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    ranges = ranges.select(
        "length_range",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("length_range").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    rows = counts.join(ranges, "length_range").select(
        "n_tokens", "n_docs", "tokens",
        (F.col("later_docs") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("later_tokens") + F.sum("tokens").over(inside)).alias("tokens_from"),
        "all_docs", "all_tokens",
    )
    below = F.col("all_tokens") - F.col("tokens_from")
    return rows.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from",
        (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (below + F.col("n_tokens") * F.col("docs_from")).alias("truncated"),
        "all_docs", "all_tokens",
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, tokens in all, tokens left when cut at it.

    The first histogram length above a limit holds the suffix sums it needs.
    """
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    over = histogram.join(F.broadcast(asked), F.col("n_tokens") > F.col("limit"), "inner")
    first = over.groupBy("limit").agg(F.min(F.struct("n_tokens", "docs_from", "tokens_from")).alias("f"))
    total = histogram.agg(F.max("all_tokens").alias("total"))
    return asked.join(first, "limit", "left").select(
        "limit",
        F.coalesce("f.docs_from", F.lit(0)).alias("docs_over"),
        F.coalesce(total.scalar(), F.lit(0)).alias("all_tokens"),
        (F.coalesce(total.scalar(), F.lit(0)) - F.coalesce("f.tokens_from", F.lit(0))
         + F.col("limit") * F.coalesce("f.docs_from", F.lit(0))).alias("truncated"),
    )


def answer_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q in (0, 1]: the smallest length that at least q of the documents do not exceed."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    hit = histogram.join(F.broadcast(asked), F.col("docs_upto") >= F.col("share") * F.col("all_docs"))
    return hit.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
