import base64

import regex

from cartwise.llm import mixing, token_counts
from helpers import docs, words

TEXTS = [(1, "Hello there, general words."), (2, ""), (3, None), (4, "ünïcode  und\n\nmehr 12345"), (4, "dup id"),
         (5, "a" * 3000), (None, "no id"), (1, "Hello there, general words.")]


def naive_bpe(text, ranks):
    total = 0
    for piece in regex.findall(token_counts.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        total += len(parts)
    return total


def test_lengths_and_histogram(spark):
    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    expect = sorted(naive_bpe(t or "", ranks) for _, t in TEXTS)
    lengths = token_counts.token_lengths(docs(spark, TEXTS, extra=True))
    assert sorted(r[0] for r in lengths.collect()) == expect
    hist = token_counts.length_histogram(lengths)
    rows = {r["n_tokens"]: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(expect))
    for n, r in rows.items():
        assert r["docs_from"] == sum(x >= n for x in expect) and r["tokens_from"] == sum(x for x in expect if x >= n)
        assert r["docs_upto"] == sum(x <= n for x in expect) and r["truncated"] == sum(min(x, n) for x in expect)
    limits = token_counts.answer_limits(hist, [0, 1, 5, 10**6])
    for r in limits.collect():
        assert r["truncated"] == sum(min(x, r["limit"]) for x in expect)
        assert r["docs_over"] == sum(x > r["limit"] for x in expect) and r["all_tokens"] == sum(expect)
    got = {r["share"]: r["n_tokens"] for r in token_counts.answer_quantiles(hist, [0.5, 1.0]).collect()}
    assert got == {0.5: expect[3], 1.0: expect[-1]}
    empty = token_counts.length_histogram(token_counts.token_lengths(docs(spark, [])))
    assert empty.count() == 0 and token_counts.answer_limits(empty, [5]).first()["truncated"] == 0


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    weight, size = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 100, "b": 1000, "c": 10, None: 500}
    full, left = {}, 1.5 * 1610
    while True:  # reshare the excess until none is above
        open_ = {s: w for s, w in weight.items() if s not in full}
        now = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in now if now[s] > 2 * size[s]}
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
        left = 1.5 * 1610 - sum(full.values())
    expect = full | now
    assert all(abs(got[s] - expect[s]) < 1e-6 for s in expect)


def test_mix(spark):
    rows = [(i, "w " * (i % 7 + (200 if i == 5 else 0)), ["x", "y", None, "z"][min(i % 9, 3)]) for i in range(120)]
    rows += [(1, None, "y"), (None, "one two", "x"), (7, "w " * 7, "q"), (7, "w " * 7, "q"), (8, " \t", "blank")]
    df = docs(spark, rows, extra=True)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    total = sum(len(words(t)) for _, t, _ in rows)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), own in by.items():
        taken = sum(r["taken"] for r in own)
        sources = max(1, round(taken / target)) if target else 1  # some are equal in size and target
        assert abs(taken - sources * target) <= sources * (2 * max(r["size"] for r in own) + 1)
    assert sorted(map(str, mixing.mix_report(df.repartition(5)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "round", "_finish", "_taken"]
    out = mixed.collect()
    assert sum(r["_taken"] for r in out) == sum(r["taken"] for r in got)
    assert all(len(words(r["text"])) == r["_taken"] for r in out)
    assert mixing.mix_report(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, ""), (2, None)])).count() == 0
