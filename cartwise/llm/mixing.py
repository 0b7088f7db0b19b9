"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.llm.text import free_name
from cartwise.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds SHARE times all words, and REPEAT times a source or document at most.
SHARE = 1.5
REPEAT = 2
#: Ranges of the shuffle key and of the virtual finish time; a task sorts one of them.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeat: int = REPEAT) -> DataFrame:
    """(source, source_size), one row per source -> the same with weight and target.

    Sources in code point order, null last, take the weights in turn.  A
    target stops at ``repeat`` times the source's size and the excess goes to
    the others by weight.  In the order of size per weight the sources fill up
    one after the other, so running sums find the level without rounds.  Only
    the rows of this small table are windowed without a key.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("all_size"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before_size"),
    )
    rows = rows.withColumn("left_over", F.lit(share) * F.col("all_size") - F.lit(repeat) * F.col("before_size"))
    full = F.col("weight") * F.col("left_over") >= F.lit(repeat) * F.col("source_size") * F.col("open_weight")
    rows = rows.withColumn("full", full)
    first_open = F.max(F.when(~F.col("full"), F.struct("open_weight", "left_over"))).over(Window.partitionBy())
    target = F.when(F.col("full"), (F.lit(repeat) * F.col("source_size")).cast("double")).otherwise(
        F.col("weight") * first_open["left_over"] / first_open["open_weight"]
    )
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _source_key(source: Column) -> Column:
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _timed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows with their source's size and target and ``passed``, the shuffled running size."""
    inside = Window.partitionBy("source_key", "shuffle_range").orderBy("shuffle_key", "size", "tie")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(offsets, ["source_key", "shuffle_range"])
    return rows.withColumn("passed", F.col("offset") + running)


def _finish(k: int) -> Column:
    """Virtual finish time of a document's copy in round ``k`` over its source; none without a target."""
    return F.try_divide(F.col("passed") + F.lit(k) * F.col("source_size"), F.col("target"))


def _edge(timed: DataFrame, budget: int, repeat: int) -> tuple | None:
    """The copy at which the budget ends, as (finish, none, name, round, passed, words it still gives).

    The finish time grows evenly with the words of each source, so equal-width
    ranges of it hold about equal shares of the mix.  Their totals tell the
    range that the budget ends in; only that range is sorted to find the copy.
    """
    copies = timed.where("size > 0 and target > 0").select(
        F.explode(F.array(*[F.struct(_finish(k).alias("finish"), F.lit(k).alias("round")) for k in range(repeat)]))
        .alias("copy"), "source_key", "passed", "size",
    ).select("copy.*", "source_key", "passed", "size")
    copies = copies.withColumn("time_range", F.floor(F.col("finish") * RANGES))
    totals = copies.groupBy("time_range").agg(F.sum("size").alias("in_range"))
    so_far = Window.orderBy("time_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("in_range").over(so_far), F.lit(0)))
    last = totals.where((F.col("before") < budget) & (F.col("before") + F.col("in_range") >= budget))
    inside = Window.partitionBy("time_range").orderBy("finish", "source_key", "round", "passed")
    upto = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = copies.join(last.select("time_range", "before"), "time_range").withColumn("upto", upto)
    at = placed.where((F.col("upto") - F.col("size") < budget) & (F.col("upto") >= budget)).select(
        "finish", "source_key.none", "source_key.name", "round", "passed",
        (budget - F.col("upto") + F.col("size")).alias("part"),
    ).first()
    return tuple(at) if at else None


def _given(edge: tuple | None, k: int) -> Column:
    """Words that round ``k`` of a document gives: all before the edge, a part at it, none behind."""
    if edge is None:
        return F.lit(0).cast("long")
    finish, none, name, rnd, passed, part = edge
    here = F.struct(_finish(k).alias("a"), F.col("source_key.none").alias("b"), F.col("source_key.name").alias("c"),
                    F.lit(k).alias("d"), F.col("passed").alias("e"))
    there = F.struct(F.lit(finish).alias("a"), F.lit(none).alias("b"), F.lit(name).alias("c"),
                     F.lit(rnd).alias("d"), F.lit(passed).cast("long").alias("e"))
    words = F.when(here < there, F.col("size")).when(here == there, F.lit(part).cast("long")).otherwise(F.lit(0))
    return F.when((F.col("size") > 0) & (F.col("target") > 0), words).otherwise(F.lit(0)).cast("long")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float,
             repeat: int, seed: str, whole: bool) -> tuple[DataFrame, tuple | None]:
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    wide = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("id"),
        _source_key(F.col(source_col).cast("string")).alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("shuffle_key"),
        F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("shuffle_range"),
        F.xxhash64(text_col).alias("tie"),
    )
    thin = materialize(wide.drop("row"), "mix-sizes")
    ranges = materialize(
        thin.groupBy("source_key", "shuffle_range").agg(F.sum("size").alias("in_range")), "mix-ranges")
    sizes = ranges.groupBy("source_key").agg(F.sum("in_range").alias("source_size"))
    named = sizes.select(F.when(~F.col("source_key.none"), F.col("source_key.name")).alias("source"), "source_size")
    goal = targets(named, weights, share, repeat).select(
        _source_key(F.col("source")).alias("source_key"), "source_size", "target")
    before = Window.partitionBy("source_key").orderBy("shuffle_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    offsets = materialize(offsets.join(goal, "source_key").drop("in_range"), "mix-offsets")
    total = ranges.agg(F.sum("in_range")).first()[0] or 0
    timed = _timed(thin, offsets)
    edge = _edge(timed, int(share * total), repeat)
    return (_timed(wide, offsets) if whole else timed), edge


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
               seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target (its source's), taken.

    Null texts and texts without words have size 0 and give nothing; a null
    source is a source of its own, the last.  A null id shuffles as an empty
    one.  Repeated rows are documents of their own.  No rows give no rows.
    Reruns agree: the order depends on the ids, sizes and texts alone.
    """
    timed, edge = _planned(docs, id_col, text_col, source_col, weights, share, repeat, seed, whole=False)
    taken = sum((_given(edge, k) for k in range(1, repeat)), _given(edge, 0))
    return timed.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"),
                        "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
        seed: str = "mix") -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: one row per copy that is taken.

    All columns of ``docs`` (the text of the last copy cut to the words it
    gives), then round, finish and taken; those names get a leading underscore
    where ``docs`` has them.  Nulls, repeats and empty input as in
    ``mix_report``.
    """
    timed, edge = _planned(docs, id_col, text_col, source_col, weights, share, repeat, seed, whole=True)
    names = [free_name(docs.columns, c) for c in ("round", "finish", "taken")]
    copy = F.array(*[F.struct(F.lit(k).alias("round"), _finish(k).alias("finish"), _given(edge, k).alias("taken"))
                     for k in range(repeat)])
    rows = timed.select("row", "size", "source_key", F.explode(copy).alias("copy")).where("copy.taken > 0")
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(WORD), F.lit(0))
    first_words = F.array_join(F.slice(words, F.lit(1), F.col("copy.taken").cast("int")), " ")
    text = F.when(F.col("copy.taken") == F.col("size"), F.col(f"row.{text_col}")).otherwise(first_words)
    rows = rows.repartitionByRange("copy.finish", "source_key").sortWithinPartitions("copy.finish", "source_key")
    return rows.select(
        *[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns],
        *[F.col(f"copy.{c}").alias(n) for c, n in zip(("round", "finish", "taken"), names)],
    )
