"""Small fixtures shared by the operator tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, source string"


def docs(spark, rows, extra=False):
    """Documents from (doc_id, text[, source]); ``extra`` adds columns with names the operators use."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("size", "score", "fp", "label", "hits", "row", "words", "key", "finish", "taken", "dup"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return (text or "").encode().split()


def union_find(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
