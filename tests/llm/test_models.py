import hashlib
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from cartwise.llm import lm, quality, secret_scan
from cartwise.llm.text import Words, mix64
from helpers import docs, lower, words

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(d, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    again = quality.classify(d.repartition(3), labels.repartition(2))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_quality_score_against_plain_loops():
    """Features, their average and the softmax, one by one."""
    texts = [t.encode() for t in ("the cat sat, the cat", "x", "", " \t\n", "ä日 ab\nab  ab", "long words " * 400)]

    def buckets(text):
        hashes = [Words([w], lower=False).hash for w in words(text.decode())]
        out = [int(h[0]) % quality.BUCKETS for h in hashes]
        out += [int(mix64(a ^ b)[0]) % quality.BUCKETS for a, b in zip(hashes, hashes[1:])]
        for n in quality.GRAMS:
            for i in range(len(text) - n + 1):
                gram = int.from_bytes(text[i : i + n], "little") * (0x9E3779B1 + 2 * n) % (1 << 32)
                out.append(gram * quality.BUCKETS >> 32)
        return out

    bucket, bounds = quality.features(texts)
    for t, s, e in zip(texts, bounds, bounds[1:]):
        assert Counter(bucket[s:e].tolist()) == Counter(buckets(t))
    own = [np.unique(buckets(t), return_counts=True) for t in texts if buckets(t)]
    model = quality.train([(b, c / c.sum()) for b, c in own], np.arange(len(own)) % 2, steps=30)
    for t, got in zip(texts, model.scores(texts)):
        found = buckets(t)
        mean = sum((model.vectors[b].astype(float) for b in found), np.zeros(quality.DIM)) / max(1, len(found))
        e = np.exp(mean @ model.weights + model.bias)
        assert abs(got - e[1] / e.sum()) < 1e-6


def test_quality_edge_cases(spark):
    rows = [(i, ("fine plain words again and so on " * 3) if i % 2 else "XX!! YY!! ZZ!! " * 5) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "plain words"), (1, rows[1][1]), (102, "long " * 30000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (100, 1)], "doc_id long, quality int")
    df = docs(spark, rows, extra=True)
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    assert quality.accepted(df, labels).columns == df.columns
    none = quality.classify(df, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 for r in none)
    assert quality.classify(df.limit(0), labels).count() == 0


def lm_rows():
    rows = [(i, f"The cat {i % 7} sat on the mat{'.' * (i % 3)} Nr{i}") for i in range(60)]
    return rows + [(100, ""), (101, None), (None, "the cat"), (3, "The cat"), (102, "mat " * 5000), (103, "ungesehen äö 日本")]


def test_lm_base_and_score(spark):
    rows = lm_rows()
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(docs(spark, rows, extra=True)).collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    train, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            train.update(words(lower(t or "")))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    for i, t in rows:
        w = words(lower(t or ""))
        r = got[(i, len(w) + 1)]
        expect = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(train[x] for x in w), ends])
        assert r["held_out"] == held(i) and r["train_tokens"] == n
        assert r["n_known"] == sum(train[x] > 0 for x in w) + 1
        assert abs(r["base_score"] - expect) < 1e-6 * max(1, -expect) and r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score(docs(spark, [])).count() == 0


def test_lm_learns_from_every_training_document(spark):
    """What only documents beyond any fixed number of them say is in the model, however they are dealt."""
    ids = sorted((i for i in range(900) if zlib.crc32(str(i).encode()) % 10), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    late = set(ids[500:])
    df = docs(spark, [(i, "plain words here " * 4 + ("then zebra music " * 3 if i in late else "")) for i in range(900)])
    with open(lm.VOCABULARY, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    cuts = lm.Cuts(vocabulary.value)

    def fitted(df, **more):
        rows = lm._rows(df, "doc_id", "text")
        return lm.fit(rows, lm.word_counts(rows), len(ids), vocabulary, **more)

    model = fitted(df, shard_tokens=3000)
    lex = model.lexicon
    zebra, music = (np.frombuffer(cuts[w], dtype=np.uint16) for w in (b"zebra", b"music"))
    row = model.p["pair"][lex.input[zebra[-1]]]
    assert row[lex.cls[music[0]] // lm.MEMBERS] > 0.2  # 0 for an id that no fitted document has
    again = fitted(df.repartition(5), shard_tokens=3000)
    assert all(np.allclose(model.p[k], again.p[k], atol=1e-4) for k in model.p)


def test_lm_windows_and_probabilities():
    with open(lm.VOCABULARY, "rb") as f:
        cuts = lm.Cuts(f.read())
    texts = [lm._ids(words(t), cuts) for t in ("a b c", "", "the cat sat on the mat " * 30)]
    counts = np.bincount(np.concatenate(texts), minlength=lm.IDS).astype(float)
    model = lm.Model(lm.Lexicon(counts, lm.starts_word(cuts)))
    model.fit(texts, steps=20)
    lengths = np.array([len(t) for t in texts])
    text, start = lm.windows(lengths)
    for k, n in enumerate(lengths):  # each token is new in exactly one window
        seen = Counter(p for s in start[text == k] for p in range(s + (lm.WINDOW - lm.STRIDE if s else 0), min(n, s + lm.WINDOW)))
        assert set(seen) == set(range(n)) and set(seen.values()) == {1}
    whole = model.log_probs(np.concatenate(texts), lengths, batch=3)
    alone = [model.log_probs(t, np.array([len(t)]))[0] for t in texts]
    assert np.allclose(whole, alone, rtol=1e-5)
    h = np.random.default_rng(0).standard_normal((1, lm.DIM)).astype(np.float32)
    each = model.classes(np.repeat(h, lm.CLASSES, 0), np.zeros(lm.CLASSES, int), np.arange(lm.CLASSES))
    assert abs(np.exp(each.astype(float)).sum() - 1) < 1e-3
    inside = np.bincount(model.lexicon.cls, weights=np.exp(model.lexicon.inside), minlength=lm.CLASSES)
    assert np.allclose(inside[inside > 0], 1)


def test_cuts_at_once_and_alone():
    with open(lm.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    words = list(dict.fromkeys("the cat's 1234 x\u00a0y \u00a0z\u00a0 日本語 a--b don't :) é́ \u2003".encode().split()))
    alone, once = lm.Cuts(vocabulary), lm.Cuts(vocabulary)
    once.learn(words)
    assert len(once) == len(words) and all(once[w] == alone[w] for w in words)


def test_lm_gradients():
    """The analytic gradients agree with finite differences."""
    counts = np.zeros(lm.IDS)
    counts[:3000] = np.arange(3000, 0, -1)
    model = lm.Model(lm.Lexicon(counts, np.arange(lm.IDS) % 2 == 0))
    rng = np.random.default_rng(1)
    model.p = {k: (p + rng.standard_normal(p.shape) * 0.05).astype(np.float64) for k, p in model.p.items()}
    x, y = rng.integers(0, 50, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    real = np.ones_like(x, dtype=bool)
    real[0, 9:] = False

    def loss():
        h = model.forward(x, 0)["h2"].reshape(-1, lm.DIM)
        return -model.classes(h, x.reshape(-1), y.reshape(-1))[real.reshape(-1)].mean()

    before = {k: p.copy() for k, p in model.p.items()}
    state = {}
    model.step(x, y, real, state, 0.0)
    for name in ("q", "k", "v", "o", "w1", "w2", "out", "pos", "emb"):
        grad = state[name][0] / 0.1
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        model.p[name][at] = before[name][at] + 1e-3
        up = loss()
        model.p[name][at] = before[name][at] - 1e-3
        down = loss()
        model.p[name][at] = before[name][at]
        assert abs((up - down) / 2e-3 - grad[at]) < 0.03 * abs(grad[at]) + 1e-4, name


def secret_rows():
    key = "AKIA" + "ABCD2345EFGH67JK"
    rows = [(i, f"plain prose {i} password={i:02d}b7aa9d4d9e0f1c22{i:02d} more text") for i in range(30)]
    rows += [(100 + i, f'see token = "{i:02d}cc631f6559e745b37cb8be6fc63ae2d235c5{i:02d}" and {key[:-2]}{i:02d}') for i in range(30)]
    rows += [(200 + i, f"card 40418949746088{i:02d} mail longname{i}4@mail8.example.com commit={i:02d}31f6559e745b37cb8be6fc63") for i in range(40)]
    return rows + [(300, "UNINTERRUPTEDSHOUTINGWORDS again"), (301, ""), (302, None), (None, f"x {key} y"), (1, rows[1][1]),
                   (303, "word " * 20000 + f" secret: {key}")]


def test_secrets(spark):
    rows = secret_rows()
    df = docs(spark, rows, extra=True)
    got = secret_scan.scan(df).collect()
    text = {i: t for i, t in rows}
    for r in got:
        found = text[r["doc_id"]][r["start_pos"] : r["end_pos"]]
        real = found.startswith("AKIA") or "password=" in text[r["doc_id"]] or "token =" in text[r["doc_id"]]
        assert r["is_secret"] == real, (r, found)
    assert sum(r["is_secret"] for r in got) == 30 + 60 + 1 + 1 + 1
    clean = {(r["doc_id"], r["text"]) for r in secret_scan.redact(df).collect()}
    assert not any("AKIA" in (t or "") or "password=0" in (t or "") for _, t in clean)
    assert (302, None) in clean and (301, "") in clean and (300, rows[100][1]) in clean
    assert secret_scan.redact(df).columns == df.columns
    assert secret_scan.scan(df.limit(0)).count() == 0
    alone = secret_scan.scan(df.where("doc_id = 303")).collect()  # one kind of label only: the rules decide
    assert [r["is_secret"] for r in alone] == [True]


def test_secrets_of_any_length_and_in_dotted_tokens_and_urls(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dBjftJeZ4CVPmB92K27uhbUJU1p1rwW1gFWFOEj{:02d}"
    kinds = ['password = "Summer20{:02d}!" end', "db_password: P@ssw0rd!x{:02d} end", "PASSWORD='correct horse battery nr{:02d}' end",
             "Authorization: Bearer " + jwt + " end", "see " + jwt + " end", "postgres://admin:S3cr!et{:02d}@db.example.com/x end"]
    start = ["Summer", "P@ss", "correct", "eyJ", "eyJ", "S3cr"]
    rows = [(100 * k + i, t.format(i)) for k, t in enumerate(kinds) for i in range(30)]
    rows += [(1000 + i, f"mail longname{i}4abc@mail8.example.com commit={i:02d}31f6559e745b37cb8be6fc63") for i in range(90)]
    found = {(r["doc_id"], r["start_pos"]) for r in secret_scan.scan(docs(spark, rows)).collect() if r["is_secret"]}
    assert found == {(i, t.index(start[i // 100])) for i, t in rows if i < 1000}
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, rows)).collect()}
    assert clean[0] == 'password = "[SECRET]" end' and clean[500] == "postgres://admin:[SECRET]@db.example.com/x end"
    assert clean[300] == "Authorization: Bearer [SECRET] end" and clean[200] == "PASSWORD='[SECRET]' end"


def test_prose_after_a_secret_name_is_left_to_the_forest():
    label, _ = secret_scan.describe("the key: patience wins", 9, 17, {"patience"})
    assert label is None and list(secret_scan.findings("monkey: bananas")) == []


def test_forest_reads_the_model(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0)).astype(float)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "label double, features array<double>")
    df = df.withColumn("x", array_to_vector("features"))
    model = RandomForestClassifier(numTrees=9, maxDepth=5, seed=1, featuresCol="x", labelCol="label").fit(df)
    votes = np.mean([[t.predict(r["x"]) for r in df.select("x").collect()] for t in model.trees], axis=0)
    assert np.allclose(secret_scan.Forest(model.toDebugString).scores(x), votes)


def test_a_pass_that_cuts_nothing_drops_cuts_and_tokenizers(spark):
    from cartwise.llm import token_counts

    with open(token_counts.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    texts = spark.createDataFrame([(i, f"Größe 東京 word{i} a a") for i in range(40)], "doc_id long, text string")

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            cuts = lm.cuts_of(vocabulary)
            cuts.learn([b"word", "東京".encode()])
            before = len(lm._CUTS) + len(token_counts._ENCODERS)
            lm.forget_cuts()
            yield pa.RecordBatch.from_pydict({"before": [before], "after": [len(lm._CUTS) + len(token_counts._ENCODERS)]})

    assert {tuple(r) for r in texts.coalesce(1).mapInArrow(held, "before long, after long").collect()} == {(2, 0)}
    counts = {r["word"]: r["n_all"] for r in lm.word_counts(lm._rows(texts, "doc_id", "text")).collect()}
    assert counts == {"größe": 40, "東京": 40, "a": 80, **{f"word{i}": 1 for i in range(40)}}
