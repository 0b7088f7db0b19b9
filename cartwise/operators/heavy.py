"""Heavy join keys: a mergeable frequency sketch finds them, a salted join splits them.

A sketch is one row per table or part of a table, whatever the number of
rows, and sketches of parts merge to that of the whole.  It overestimates a
key by a small share of all rows at most and never misses a key above that
share, so it is enough to decide which keys are worth splitting; results do
not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch keeps counters for; its error is below 4 / TRACKED of the rows.
TRACKED = 4096
#: Heaviest keys that a join splits: the bound of what it broadcasts.
MOST = 512
#: Rows of a heavy key that one salt value keeps together, expected.
ROWS = 100_000


def frequency_sketch(df: DataFrame, key: str, by: tuple[str, ...] = (), tracked: int = TRACKED) -> DataFrame:
    """Columns ``by`` and ``state``: the frequency sketch of ``key`` over all rows or for each value of ``by``."""
    state = F.expr(f"approx_top_k_accumulate(`{key}`, {int(tracked)})").alias("state")
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(*by).agg(state) if by else rows.agg(state)


def merge_sketches(sketches: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One sketch (column ``state``) of all rows that some sketches have seen."""
    return sketches.agg(F.expr(f"approx_top_k_combine(state, {int(tracked)})").alias("state"))


def heavy_keys(sketch: DataFrame, key: str, least: int, most: int = MOST) -> DataFrame:
    """(key, n): the keys of one sketch with about ``least`` rows and more, ``most`` of them at most."""
    top = sketch.select(F.explode(F.expr(f"approx_top_k_estimate(state, {int(most)})")).alias("t"))
    return top.select(F.col("t.item").alias(key), F.col("t.count").alias("n")).where(F.col("n") >= least)


def parts_of(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """(key, parts): into how many parts each heavy key of ``df`` is to be split (bounded rows)."""
    found = heavy_keys(frequency_sketch(df, key), key, rows + 1)
    return found.select(key, F.ceil(F.col("n") / rows).cast("int").alias("parts"))


def with_parts(df: DataFrame, parts: DataFrame, key: str, name: str = "parts") -> DataFrame:
    """``df`` with the number of parts of its key, 1 for keys that are not heavy.

    ``parts`` has MOST rows at most, so it is broadcast.
    """
    own = parts.select(F.col(key).alias("_heavy"), F.col("parts").alias("_parts"))
    out = df.join(F.broadcast(own), F.col(key) == F.col("_heavy"), "left")
    return out.withColumn(name, F.coalesce("_parts", F.lit(1))).drop("_heavy", "_parts")


def part_of(parts: Column, *keys: str) -> Column:
    """The part that a row goes to, by a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), parts).cast("int")


def salted_join(left: DataFrame, right: DataFrame, key: str, parts: DataFrame, spread: tuple[str, ...]) -> DataFrame:
    """Inner equi-join on ``key``: rows of a heavy key in ``left`` are dealt by ``spread``, those in ``right`` repeated.

    The shuffle is keyed by (key, part), so a key of a third of all rows is
    as many join groups as it has parts.  NULL keys match nothing.
    """
    a = with_parts(left, parts, key).withColumn("_part", part_of(F.col("parts"), *spread)).drop("parts")
    b = with_parts(right, parts, key).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return a.join(b, [key, "_part"]).drop("_part")
