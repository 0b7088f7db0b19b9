"""Session helpers: a local session for tests/bench and checkpoint-dir resolution."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cartwise") -> SparkSession:
    """Session used by tests and the bench.  A cluster job passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Only when nothing is set and the master is local (tests) do we
    create a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cartwise-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return sc.getCheckpointDir()


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES = threading.Lock()
_OPEN_WRITES: dict[str, list] = {}


@contextlib.contextmanager
def shuffle_files_removed(spark: SparkSession):
    """While any write of the session is in here, shuffle files leave with the job that wrote them."""
    key = spark.sparkContext.applicationId
    with _WRITES:
        held = _OPEN_WRITES.setdefault(key, [])
        if not held:
            held.append(spark.conf.get(_CLEAN_UP, "false"))
            spark.conf.set(_CLEAN_UP, "true")
        held.append(None)
    try:
        yield
    finally:
        with _WRITES:
            held.pop()
            if len(held) == 1:
                spark.conf.set(_CLEAN_UP, held.pop())


def stage_folder(spark: SparkSession, label: str) -> str:
    """A new folder among the stages, deleted with them."""
    path = f"{ensure_checkpoint_dir(spark)}/cartwise-stage/{label}-{uuid.uuid4().hex}"
    _STAGES.append(path)
    return path


def materialize(df, label: str = "stage"):
    """Write ``df`` as parquet into the reliable checkpoint folder and read it back.

    Used by the plans layer at stage boundaries that several consumers read
    (merged lines, edges, metrics): the work runs once, lineage is cut, a lost
    executor does not force recomputation, and later scans get column pruning.
    The shuffle files of the job that wrote a stage are removed as it ends, not
    when the driver happens to collect its garbage.
    """
    return _written(df, stage_folder(df.sparkSession, label))


def _written(df, path: str):
    spark = df.sparkSession
    with shuffle_files_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Stages of an iterative job.  With ``keep``, only the newest so many stay."""

    def __init__(self, label: str, keep: int | None = None):
        self.label, self.keep, self.paths = label, keep, []

    def put(self, df):
        """Stage ``df``; what this makes too old is deleted."""
        path = stage_folder(df.sparkSession, self.label)
        out = _written(df, path)
        self.paths.append(path)
        while self.keep and len(self.paths) > self.keep:
            _delete(df.sparkSession, self.paths.pop(0))
        return out

    def delete(self, spark: SparkSession) -> None:
        while self.paths:
            _delete(spark, self.paths.pop())


class Bucketed:
    """A table written once in buckets of ``key``, so that joins on ``key`` never shuffle it again.

    The files lie in a stage folder; the session's catalog knows them by a
    name of their own until ``drop``.
    """

    def __init__(self, df, key: str, label: str, buckets: int | None = None, dealt: bool = False):
        """``dealt``: ``df`` comes out of a shuffle by ``key`` alone, so that it is not shuffled once more."""
        spark = df.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path = f"cartwise_{label.replace('-', '_')}_{uuid.uuid4().hex}", stage_folder(spark, label)
        self.spark, self.buckets = spark, n
        with shuffle_files_removed(spark):
            (df if dealt else df.repartition(n, key)).write.option("path", self.path).bucketBy(n, key).sortBy(key).saveAsTable(self.name)
        self.table = spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def together(spark, *builds):
    """The results of ``builds``, run at once: the short jobs of one fill the pauses of the others."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(b)) for b in builds]]


def by_range(df, *keys: str, name: str = "range_no"):
    """``df`` range-partitioned by ``keys`` with the number of each row's range, staged.

    Spark samples the keys for the bounds, so ranges hold about equal numbers
    of rows whatever the values; the stage keeps them fixed for later reads.
    """
    from pyspark.sql import functions as F

    return materialize(df.repartitionByRange(*keys).withColumn(name, F.spark_partition_id()), "ranges")


def materialize_by(df, key: str, label: str = "stage"):
    """``materialize`` in buckets of ``key``: ``df`` has been dealt by ``key``, joins and groups on it shuffle nothing."""
    made = Bucketed(df, key, label, dealt=True)
    _TABLES.append(made)
    return made.table


_STAGES: list[str] = []
_TABLES: list[Bucketed] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _STAGES:
        _STAGES.remove(path)


def delete_stages(spark: SparkSession) -> None:
    """Delete the stages this process has written; call it when their results have been used."""
    while _TABLES:
        _TABLES.pop().drop()
    while _STAGES:
        _delete(spark, _STAGES[-1])
