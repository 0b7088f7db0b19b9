import hashlib
import random

from cartwise.llm import decontaminate, substring_dedup
from cartwise.llm.text import Words, gram_hash
from helpers import docs, lower, words


def spans_corpus():
    rng = random.Random(3)
    say = lambda n, v=60: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, line, loop = say(70), say(25), ["To"] * 33 + ["erreon"] * 28
    rows = [(1, say(40) + passage + say(30)), (2, passage[20:60] + say(10) + line), (3, say(5) + line + say(3) + line),
            (4, loop + say(30)), (5, say(19)), (6, passage), (7, passage), (9, ["a", "b", "c"] * 20 + say(25) + ["a", "b", "c"] * 9),
            (12, passage[:35] + ["x"] + passage[36:]), (13, say(300, 4))]
    rows = [(i, " ".join(w)) for i, w in rows]
    rows += [(14, rows[0][1].replace(" ", "\n\t ")), (15, ""), (16, None), (17, rows[0][1].upper()), (18, " \n"),
             (None, rows[0][1]), (1, rows[0][1]), (19, "ü x " * 50), (20, " ".join(say(4000, 500) + passage))]
    return rows


def brute_spans(rows, span=20):
    distinct = sorted({(i is None, i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    first, out = {}, {}
    for none, i, t in distinct:
        w = words(t)
        drop = [False] * len(w)
        for s in range(len(w) - span + 1):
            key = tuple(w[s : s + span])
            if key in first:
                drop[s : s + span] = [True] * span
            else:
                first[key] = (i, s)
        kept = b" ".join(x for x, d in zip(w, drop) if not d)
        out[(i, t)] = (len(w), sum(drop), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_against_windows(spark):
    rows = spans_corpus()
    expect = brute_spans(rows)
    got = substring_dedup.dedup(docs(spark, rows, extra=True).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == \
        sorted((str(i), *expect[(i, t)]) for i, t in rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


def test_substring_dedup_one_id_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.dedup(docs(spark, [(1, text), (1, text + " more")])).collect()
    assert sorted(r["n_removed"] for r in got) in ([0, 30], [0, 31 - 1]) and len(got) == 2


def test_containment_against_sets(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"q{rng.randrange(900)}" for _ in range(10 + 5 * i))) for i in range(8)]
    items += [(20, "only four words here"), (21, "one"), (22, ""), (23, None), (24, items[2][1]), (25, items[3][1].upper())]
    filler = lambda n: " ".join(f"f{rng.randrange(99)}" for _ in range(n))
    rows = [(i, filler(200) + " " + t.replace(" ", "\n") + " " + filler(5000 if i == 3 else 20)) for i, t in items[:8]]
    w = items[5][1].split()
    rows += [(30, " ".join(w[:20] + ["z"] + w[21:])), (31, " ".join(w[:6] + ["z"] + w[7:14] + ["y"] + w[15:])),
             (32, "It was only Four words here, or ONE."), (33, "one"), (34, ""), (35, None), (None, items[4][1]),
             (30, " ".join(w[:20] + ["z"] + w[21:])), (36, " ".join(reversed(items[6][1].split())))]

    def grams(text, n):
        v = words(lower(text or ""))
        return {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}

    expect = []
    for d, text in rows:
        for i, item in items:
            n = min(5, len(words(item)))
            q = grams(item, n) if n else set()
            found = len(q & grams(text, n)) if q else 0
            if q and found / len(q) >= 0.8:
                expect.append((str(d), i, len(q), found))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS hits")
    df = docs(spark, rows, extra=True)
    got = decontaminate.contained_items(df, bench).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted(expect) and len(expect) > 12
    many = decontaminate.search(df, bench, "found", block_words=40).selectExpr("doc_id", "explode(found) AS h")
    assert sorted((str(r[0]), *r[1]) for r in many.collect()) == sorted(expect)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    dirty = {d for d, *_ in expect}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if str(d) not in dirty)
    assert decontaminate.contained_items(df, bench.limit(0)).count() == 0
    assert decontaminate.contained_items(df.limit(0), bench).count() == 0


def test_only_sketches_propose_items():
    rng = random.Random(8)
    say = lambda n: [f"q{rng.randrange(400)}" for _ in range(n)]
    items = [say(40) for _ in range(30)] + [say(9), say(200)]
    texts = [say(50) + w + say(50) for w in items]  # the whole item
    texts += [say(30) + w[: len(w) // 4] + say(30) for w in items]  # a quarter of it
    texts += [items[31][:30]]
    join = lambda rows: [" ".join(r).encode() for r in rows]
    sketches = decontaminate.Sketches(list(range(len(items))), join(items), 5, 0.8)
    w = Words(join(texts), lower=True)
    proposed = sketches.proposals(w, 5, gram_hash(w.hash, 5))
    grams = lambda v: {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
    share = {(d, i) for d, t in enumerate(texts) for i, v in enumerate(items) if grams(t) & grams(v)}
    assert set(proposed) <= share and len(proposed) < 0.9 * len(share)
    assert {(i, i) for i in range(len(items))} <= set(proposed)
    assert (len(texts) - 1, 31) in share and (len(texts) - 1, 31) not in proposed  # too short for the item's partition
    expect = [[(i, len(grams(v)), len(grams(v) & grams(t))) for i, v in enumerate(items)
               if len(grams(v) & grams(t)) >= 0.8 * len(grams(v))] for t in texts]
    assert sketches.hits(join(texts)) == expect
