import tempfile
import threading

from pyspark.sql import types as T

from cartwise.operators import enrich
from cartwise.sources.done_store import Commit, DoneStore

SCHEMA = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("price", T.DoubleType())])


def _store(spark, buckets=8):
    return DoneStore(spark, tempfile.mkdtemp(prefix="cartwise-done-"), SCHEMA, buckets=buckets)


def _rows(spark, ids):
    return spark.createDataFrame([(i, float(i or 0)) for i in ids], SCHEMA)


def test_batches_store_each_key_once(spark):
    s = _store(spark)
    assert s.append("a", _rows(spark, [1, 2, 2, None, 3])) == 3
    assert s.append("a", _rows(spark, [1, 2, 3, 9])) == 0  # a replay of the batch
    assert s.append("b", _rows(spark, [3, 4])) == 1
    assert s.append("empty", _rows(spark, [])) == 0
    assert sorted(r.product_id for r in s.read().collect()) == [1, 2, 3, 4]
    assert [c.batch for c in s.commits()] == ["a", "b", "empty"]
    items = _rows(spark, [1, 4, 7, None])
    assert sorted(r.product_id or 0 for r in s.pending(items).collect()) == [0, 7]
    assert sorted(r.product_id or 0 for r in enrich.pending(items, s.read()).collect()) == [0, 7]


def test_a_resume_reads_the_touched_buckets_only(spark):
    s = _store(spark)
    s.append("a", _rows(spark, range(200)))
    one = _rows(spark, [5])
    touched = s._touched(one)
    files = s.read(touched).inputFiles()
    assert len(touched) == 1 and files and all(f"bucket={min(touched)}/" in f for f in files)
    assert s.pending(one).collect() == [] and len(s.read().inputFiles()) > len(files)


def test_two_replays_at_once_add_each_key_once(spark):
    s = _store(spark)
    gate, stored = threading.Barrier(2), []

    def replay(batch, ids):
        mine = DoneStore(spark, s.root, SCHEMA, buckets=8)
        take = mine._take

        def late(commit):  # both have looked at the store before either commits
            if commit.number == 0:
                gate.wait(60)
            return take(commit)

        mine._take = late
        stored.append((batch, mine.append(batch, _rows(spark, ids))))

    for batches in (("x", "x"), ("y", "z")):
        threads = [threading.Thread(target=replay, args=(b, range(100))) for b in batches]
        for t in threads:
            t.start()
        for t in threads:
            t.join(120)
        assert sorted(n for _, n in stored) == [0, 100]
        assert sorted(r.product_id for r in s.read().collect()) == list(range(100))
        s, stored, gate = _store(spark), [], threading.Barrier(2)


def test_writers_of_other_buckets_need_no_second_look(spark):
    s = _store(spark, buckets=2)
    where = {r.product_id: r.b for r in _rows(spark, range(60)).select("product_id", s.bucket().alias("b")).collect()}
    ids = {b: [i for i, own in where.items() if own == b][:3] for b in (0, 1)}
    taken, take = [], s._take

    def raced(commit):
        if not taken:  # another writer takes the number first
            taken.append(commit.folder)
            other = DoneStore(spark, s.root, SCHEMA, buckets=2)
            other.append("other", _rows(spark, ids[1]))
        return take(commit)

    s._take = raced
    assert s.append("mine", _rows(spark, ids[0])) == 3
    assert [c.folder for c in s.commits() if c.batch == "mine"] == taken
    assert sorted(r.product_id for r in s.read().collect()) == sorted(ids[0] + ids[1])
    assert isinstance(s.commits()[0], Commit)
