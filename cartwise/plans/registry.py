"""Registry of named queries (Spark callable + DuckDB oracle text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Stage results of the query being built: each stage is materialised once per
# query call and shared by all of its consumers inside that query.
_SCOPE: list[dict] = []


def stage(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """Materialise ``build()`` once per query call, in buckets of ``by`` if given (see ``cartwise.session.materialize``)."""
    from cartwise.session import materialize, materialize_by

    key = (name, spark.sparkContext.applicationId, sf_dir)
    if _SCOPE and key in _SCOPE[-1]:
        return _SCOPE[-1][key]
    df = materialize_by(build(), by, name) if by else materialize(build(), name)
    if _SCOPE:
        _SCOPE[-1][key] = df
    return df


def staged(name: str, spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The stage ``name`` where the query being built has it already."""
    return _SCOPE[-1].get((name, spark.sparkContext.applicationId, sf_dir)) if _SCOPE else None


def once(name: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` once per query call, not written: for plans that cost a job to make."""
    key = ("plan", name, spark.sparkContext.applicationId, sf_dir)
    if not _SCOPE:
        return build()
    if key not in _SCOPE[-1]:
        _SCOPE[-1][key] = build()
    return _SCOPE[-1][key]


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    The returned DataFrame has its floating columns rounded by ``round_doubles``
    so it compares value-for-value with the oracle (which rounds the same columns).
    """

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _SCOPE.append({})
            try:
                return round_doubles(fn(spark, sf_dir))
            finally:
                _SCOPE.pop()

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded alike on both sides of a comparison.

    Values of one and more keep ``digits`` decimals: round(x * 10^d) / 10^d on
    the binary value, the same rule as DuckDB's round(x, d).  Smaller values
    keep the 24 significant bits of a single-precision float, so measures that
    shrink with the number of nodes (PageRank, centralities) stay distinct at
    any size.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x, scale = F.col(f.name), float(10**digits)
            small = x.cast("float").cast("double")
            cols.append(F.when(F.abs(x) < 1, small).otherwise(F.round(x * scale) / scale).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from cartwise.plans import q_enrich, q_features, q_graph, q_models, q_prep, q_recommend, q_reports  # noqa: F401
