import random

import numpy as np
import xxhash

from cartwise.llm import embedding_dedup, simhash
from cartwise.llm.components import components
from helpers import docs, lower, union_find, words


def brute_print(text):
    w = words(lower(text or ""))
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(999)}" for _ in range(400))
    out = [(10, base), (11, base.upper()), (12, base + " tail"), (13, "x " + base)]
    for i in range(20, 60):
        w = base.split()
        w[rng.randrange(400)] = f"v{i}"
        out.append((i, " ".join(w)))
    out += [(70, ""), (71, None), (72, " \t\n"), (73, "two words"), (74, "Two Words"), (75, "ä b c d")]
    out += [(10, base), (None, "two words"), (None, None), (None, "alone by itself here"), (None, "alone by itself here")]
    return out


def test_simhash_against_pairs(spark):
    rows = near_texts()
    fps = [brute_print(t) for _, t in rows]
    n = len(rows)
    root = union_find(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root[i]] = min(ids.get(root[i], d), d)
    expect = sorted(((d is None, d, f"{f:016x}", ids.get(root[i])) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)
    df = docs(spark, rows, extra=True)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r[0] is None, *r) for r in got), key=str) == expect
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = len(set(root))
    out = kept.collect()
    assert len(out) == groups and {r["doc_id"] for r in out if r["doc_id"] is not None} == set(ids.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_large_block_connects_what_pairs_connect(spark):
    """Hundreds of variants of one fingerprint share blocks; stars connect them like all pairs do."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ 1 << a ^ 1 << b for a in range(12) for b in range(64)}
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    root = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert links.count() < len(fps) * 40
    label = {r["id"]: r["label"] for r in components(links).collect()}
    mine, theirs = {}, {}
    for i, f in enumerate(signed):
        mine.setdefault(label.get(f, f), set()).add(i)
        theirs.setdefault(root[i], set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_pairs(spark):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.standard_normal((5, 24))
    for i in range(260):
        v = centre[i % 5] + rng.standard_normal(24) * (0.03 if i % 3 else 1.0)
        rows.append((i, (v * (1 + i % 4)).astype(np.float32).tolist(), i % 2))
    rows += [(300 + i, rows[1][1], 1) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [float("inf")] + [1.0] * 23, 1),
             (404, [None] + [1.0] * 23, 1), (405, rows[1][1], None), (406, rows[1][1][:10], 1), (407, [], 1),
             (None, rows[1][1], 1), (1, rows[1][1], 1)]
    good = [i for i, (_, v, label) in enumerate(rows)
            if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for x in good:
        for y in good:
            if x < y and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1], dtype=float), np.array(rows[y][1], dtype=float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links.append((x, y))
    root, n_links, least = union_find(len(rows), links), [0] * len(rows), {}
    for x, y in links:
        n_links[x] += 1
        n_links[y] += 1
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    expect = sorted((str(r[0]), n_links[i], least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS v", "2 AS cid")
    for tile in (4096, 16):  # one unit, and a slab of many tiles
        got = embedding_dedup.near_duplicates(df, tile=tile).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == expect
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id = 400")).count() == 1


def test_large_block_at_smaller_distances(spark):
    """At distance 1 and 0 a large block connects what all pairs connect, too."""
    rng = random.Random(4)
    fps = sorted(rng.sample(range(1 << 9), 260))  # dense: one block of each mask that spares the low bits
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 1])
    links = simhash.fingerprint_links(frame, 1).collect()
    assert len(fps) > 2 * simhash.DIRECT and all((r["a"] ^ r["b"]).bit_count() == 1 for r in links)
    at = {f: i for i, f in enumerate(fps)}
    assert union_find(len(fps), [(at[r["a"]], at[r["b"]]) for r in links]) == root
    assert simhash.fingerprint_links(frame, 0).count() == 0
