"""Store of finished rows by key (A4, B1, D12): buckets by key hash, and one commit a batch.

A batch writes its new rows to a folder of its own, one subfolder a bucket,
and is in the store once its commit exists.  Commits are numbered; a number
is taken by creating its file, which fails if it is there.  So of writers
that run at once one takes the number, and the others look again at the
buckets that it touched before they try the next.  Readers see committed
folders only, and a resume reads the buckets of the keys that it asks for.

The file system must create a file exclusively (HDFS does; on a local one
writers in one process are kept apart by a lock).
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Seconds that a reader waits for a commit whose file is there but not written yet.
PATIENCE = 30
_LOCAL = threading.Lock()


@dataclass(frozen=True)
class Commit:
    number: int
    batch: str
    folder: str
    buckets: tuple[int, ...]
    rows: int


class DoneStore:
    """Rows of ``schema`` with at most one row a ``key``, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "product_id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commit_path(self, number: int):
        return self._path(f"{self.root}/commits/{number:010d}.json")

    def _read(self, number: int) -> Commit | None:
        """The commit of a number, or None where it is not taken."""
        path, until = self._commit_path(number), time.time() + PATIENCE
        while self._fs.exists(path):
            stream = self._fs.open(path)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                d = json.loads(text)
                return Commit(number, d["batch"], d["folder"], tuple(d["buckets"]), d["rows"])
            if time.time() > until:
                raise RuntimeError(f"commit {number} of {self.root} was never written")
            time.sleep(0.05)
        return None

    def commits(self, start: int = 0) -> list[Commit]:
        """The commits from number ``start`` on, in order (one small file a batch)."""
        out = []
        while (c := self._read(start + len(out))) is not None:
            out.append(c)
        return out

    def _take(self, commit: Commit) -> bool:
        """Create the commit's file; False if its number is taken."""
        text = json.dumps({"batch": commit.batch, "folder": commit.folder, "buckets": commit.buckets, "rows": commit.rows})
        path = self._commit_path(commit.number)
        with _LOCAL:
            if self._fs.exists(path):
                return False
            try:
                out = self._fs.create(path, False)
            except Exception as e:
                if self._fs.exists(path):
                    return False
                raise e
            try:
                out.write(bytearray((text + "\n").encode()))
            finally:
                out.close()
        return True

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None, commits: list[Commit] | None = None) -> DataFrame:
        """The stored rows, of some buckets only if given: no other folder is listed or read."""
        commits = self.commits() if commits is None else commits
        paths = [f"{self.root}/data/{c.folder}/bucket={b}" for c in commits for b in c.buckets if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _touched(self, keys: DataFrame) -> set[int]:
        return {r["b"] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket().alias("b")).distinct().collect()}

    def pending(self, items: DataFrame) -> DataFrame:
        """``items`` without those whose key is stored; rows without a key stay pending."""
        done = self.read(self._touched(items)).select(self.key)
        return items.join(done, self.key, "left_anti")

    def append(self, batch: str, rows: DataFrame) -> int:
        """Store the rows of a batch whose key is new, one a key; the number of rows stored.

        A batch that is committed already stores nothing, whatever its rows.
        Rows without a key are not stored.  ``rows`` should be staged or cheap:
        they are read again if another writer gets in between.
        """
        rows = rows.select(*self.schema.fieldNames()).where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        touched = self._touched(rows)
        known = self.commits()
        while True:
            if any(c.batch == batch for c in known):
                return 0
            folder = f"{batch}-{uuid.uuid4().hex}"
            new = rows.join(self.read(touched, known).select(self.key), self.key, "left_anti")
            new = new.select(*self.schema.fieldNames(), self.bucket().alias("bucket"))
            new.write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
            stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(
                f"{self.root}/data/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
            mine = tuple(sorted(r["bucket"] for r in stored))
            while True:
                if self._take(Commit(len(known), batch, folder, mine, sum(r["n"] for r in stored))):
                    return sum(r["n"] for r in stored)
                late = self.commits(len(known))
                known += late
                if any(c.batch == batch or set(c.buckets) & set(mine) for c in late):
                    break
            # another writer touched the same buckets: look at them again
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
