import numpy as np
import pytest

from cartwise.operators import sampling, text_factors


def _texts(spark, parts=3):
    rng = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(12)] for k in ("fruit", "dairy", "bread", "soap")]
    rows = [(i, " ".join(rng.choice(kinds[i % 4], 6)) + f" brand{i % 17}") for i in range(240)]
    rows += [(1000, "Fruit1 fruit2, FRUIT3 brandx"), (1001, "fruit1 fruit2 fruit3 brandx"), (1002, None), (1003, " -- ")]
    return spark.createDataFrame(rows, "product_id long, combined_text string").repartition(parts)


def _matrix(spark, texts, columns):
    rows = text_factors.term_columns(texts, columns).orderBy("product_id").collect()
    return np.array([np.bincount(r["terms"], minlength=columns) for r in rows], dtype=float)


def test_gram_and_factors_match_the_matrix(spark):
    texts = _texts(spark)
    f = text_factors.fit(texts, dimensions=20, columns=128)
    x = _matrix(spark, texts, 128)
    g, held = text_factors.gram(text_factors.term_columns(texts, 128), 128)
    assert (g == x.T @ x).all() and (held == (x > 0).sum(axis=0)).all()
    assert np.allclose(f.basis.T @ f.basis, np.eye(20), atol=1e-10)
    weighted = x * f.weight
    y = np.array([r["embedding"] for r in f.transform(texts, unit=False).orderBy("product_id").collect()])
    left = np.linalg.norm(weighted - y @ f.basis.T) ** 2
    # no other basis of 20 directions leaves less: the sum of the other squared singular values
    best = (np.linalg.svd(weighted, compute_uv=False)[20:] ** 2).sum()
    assert left == pytest.approx(best, rel=1e-4)
    assert f.explained == pytest.approx(1 - best / np.linalg.norm(weighted) ** 2, rel=1e-6)


def test_vectors_do_not_depend_on_partitions(spark):
    a, b = (text_factors.fit(_texts(spark, n)) for n in (1, 7))
    assert (a.basis == b.basis).all() and (a.weight == b.weight).all()
    rows = [{r["product_id"]: r["embedding"] for r in f.transform(_texts(spark, n)).collect()} for f, n in ((a, 2), (b, 5))]
    assert rows[0] == rows[1]


def test_twins_are_nearest_and_empty_texts_are_zero(spark):
    texts = _texts(spark)
    rows = {r["product_id"]: np.array(r["embedding"]) for r in text_factors.fit(texts).transform(texts).collect()}
    assert len(rows) == 244 and not rows[1002].any() and not rows[1003].any()
    near = sorted((i for i in rows if i != 1000), key=lambda i: -float(rows[1000] @ rows[i]))
    assert near[0] == 1001 and float(rows[1000] @ rows[1001]) == pytest.approx(1.0, abs=1e-5)
    # rows of one kind are closer than rows of two
    own, other = (np.mean([rows[i] @ rows[i + d] for i in range(0, 200)]) for d in (4, 1))
    assert own > other + 0.1


def test_tables_without_words(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "product_id long, combined_text string")
    f = text_factors.fit(none)
    assert f.explained == 1.0 and [set(r["embedding"]) for r in f.transform(none).collect()] == [{0.0}, {0.0}]
    assert f.transform(none.limit(0)).collect() == []


def test_exact_samples_of_every_size(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS g")
    key = sampling.unit_hash("id")
    order = [r.id for r in df.orderBy(key, "id").collect()]
    for n in (1, 2, 37, 4999, 5000, 6000):
        got = {r.id for r in sampling.hash_sample_exact(df, ["id"], n=n).collect()}
        assert got == set(order[:n])
    # rows that share one hash are taken by their keys
    same = spark.range(50).selectExpr("id", "1 AS g")
    got = sampling.hash_sample_exact(same, ["g"], n=20)
    assert got.count() == 20
