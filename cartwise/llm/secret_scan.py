"""Secret scans: loose candidates, and a random forest that removes the false positives.

A candidate is the value after a secret name and the password of a URL,
whatever their length and characters, a token of three dotted parts, a run of
key characters with a digit, or a long upper-case run.  Findings that a known format or their neighbours settle are labelled by
rule; a forest is trained on a bounded sample of these, and decides every
finding from its length, character transitions, dictionary coverage, path
marks and neighbouring words.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwise.llm.text import free_name
from cartwise.session import materialize

WORD_LIST = "/opt/tokenizers/word_bpe_49k.json"
#: Labelled findings that the forest is trained on, at most: those with the smallest SHA-256.
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 3
#: Share of the trees that must call a finding a secret.
ACCEPT = 0.5
MASK = "[SECRET]"

RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}={0,2}")
DIGIT = re.compile(r"[0-9]")
UPPER = re.compile(r"[A-Z]{16,}$")
#: A secret name and its value, quoted or up to the next space; the password of a URL; tokens of dotted parts.
VALUE = re.compile(r"(?i:(password|passwd|pwd|secret|token|(?:api|access|private)?[_-]?key|credentials?|auth|bearer|private))"
                   r"[\"']?[ \t]{0,8}(?:=>|==?|:=?)[ \t]{0,8}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>]+))")
STEMS = ["password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private"]
URL = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
URL_BEFORE = re.compile(r"://[^\s/:@]*:$")
DOTTED = re.compile(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{6,}(?:\.[A-Za-z0-9_\-]{6,}){2,}")
PROSE = re.compile(r"[A-Za-z][a-z]*$")
#: Characters before a finding that are looked at for neighbouring words.
NEAR = 48
# Words that stand in front of secrets, words that stand in front of other long strings.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "credential",
                "auth", "bearer", "private"]
OTHER_WORDS = ["sha1", "sha256", "md5", "hash", "commit", "checksum", "uuid", "etag", "example", "sample", "dummy", "id"]
# Formats of issued keys.
KNOWN = re.compile(r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|"
                   r"sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]{6,}){2})$")
WORDS_NEAR = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
ASSIGN = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)[\"']?\s*(?:=|:|=>)\s*[\"']?$")
CLASSES = {**{c: 0 for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
           **{c: 2 for c in "0123456789"}}
FEATURES = 12 + 16 + 6


def word_list(path: str = WORD_LIST) -> set[str]:
    """Words of four letters and more from the vocabulary file of a public tokenizer."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
    return {w for w in ends if len(w) >= 4 and w.isascii() and w.isalpha()}


def coverage(candidate: str, words: set[str]) -> float:
    """Share of the characters that a left-to-right longest match with dictionary words covers."""
    low, at, covered = candidate.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(14, len(low) - at), 3, -1) if low[at : at + n] in words), 0)
        covered += n
        at += n or 1
    return covered / len(low)


def describe(text: str, start: int, end: int, words: set[str]) -> tuple[int | None, list[float]]:
    """(label by rule or None, features) of the finding ``text[start:end]``."""
    found = text[start:end]
    n, before, after = len(found), text[max(0, start - NEAR) : start], text[end : end + 2]
    kinds = [CLASSES.get(c, 3) for c in found]
    steps = Counter(zip(kinds, kinds[1:]))
    share = Counter(kinds)
    counts = Counter(found)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    cover = coverage(found, words)
    assign = ASSIGN.search(before)
    name = assign.group(1).lower() if assign else ""
    near = [w.lower() for w in WORDS_NEAR.findall(before)[-3:]]
    secret_name = any(w in name for w in SECRET_WORDS)
    other_name = any(w == name for w in OTHER_WORDS)
    url = after[:1] == "@" and bool(URL_BEFORE.search(text, max(0, start - 2 * NEAR), start))
    email = after[:1] == "@" or before[-1:] == "@"
    host = after[:1] == "." and after[1:2].isalnum() or before[-1:] == "."
    path = before[-1:] in ("/", "\\") or found.count("/") >= 2 or "://" in before[-12:]
    if url:
        email = host = path = False
        secret_name = True
    features = [
        float(n), math.log(n), len(counts) / n, entropy, cover,
        *(share[k] / n for k in range(4)), sum(c in "0123456789abcdef" for c in found) / n,
        max(counts.values()) / n, float(n % 4 == 0),
        *(steps[(a, b)] / max(1, n - 1) for a in range(4) for b in range(4)),
        float(bool(assign)), float(secret_name or any(w in SECRET_WORDS for w in near)),
        float(other_name or any(w in OTHER_WORDS for w in near)), float(path), float(bool(email)), float(bool(host)),
    ]
    # a plain word after "key: " may be prose, the forest decides
    prose = not url and before[-1:].isspace() and ":" in before[-3:] and PROSE.match(found)
    if KNOWN.match(found) or (secret_name and not other_name and not prose):
        return 1, features
    if prose:
        return None, features
    if email or host or path or other_name or share[2] == n or cover >= 0.5 or share[2] == 0:
        return 0, features
    return None, features


def findings(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) in characters of every candidate of a whole text."""
    taken = [m.span(1) for m in URL.finditer(text)]
    low = text.casefold()
    for m in VALUE.finditer(text) if any(w in low for w in STEMS) else ():  # the plain search is much cheaper
        at, name = m.start(), m.group(1)
        if at and text[at - 1].isalpha() and not (text[at - 1].islower() and name[0].isupper()):
            continue  # the end of another word
        start, end = m.span(m.lastindex)
        if m.lastindex == 4:
            end = start + len(m.group(4).rstrip(".,;:)]}"))
        taken.append((start, end))
    taken += [m.span() for m in DOTTED.finditer(text) if DIGIT.search(m.group())]
    taken += [m.span() for m in RUN.finditer(text) if DIGIT.search(m.group()) or UPPER.match(m.group())]
    last = 0
    for start, end in sorted(taken, key=lambda s: (s[0], -s[1])):
        if start >= last and end > start:
            yield start, end
            last = end


class Forest:
    """The trees of a trained forest as arrays; the score is the share of trees that vote for a secret."""

    def __init__(self, description: str):
        self.trees = []
        stack: list[int] = []
        for line in description.splitlines():
            line = line.strip()
            if line.startswith("Tree "):
                tree: list[list[float]] = []
                self.trees.append(tree)
                stack = []
            elif m := re.match(r"(If|Else) \(feature (\d+) (?:<=|>) ([^)]+)\)", line):
                if m.group(1) == "If":
                    self._child(tree, stack)
                    tree.append([int(m.group(2)), float(m.group(3)), -1, -1, 0.0])
                    stack.append(len(tree) - 1)
                else:  # back at the node whose left side is done
                    while tree[stack[-1]][2] < 0 or tree[stack[-1]][3] >= 0:
                        stack.pop()
            elif m := re.match(r"Predict: ([0-9.]+)", line):
                self._child(tree, stack)
                tree.append([-1, 0.0, -1, -1, float(m.group(1))])
        self.trees = [np.array(t, dtype=np.float64) for t in self.trees]

    @staticmethod
    def _child(tree: list[list[float]], stack: list[int]) -> None:
        while stack and tree[stack[-1]][3] >= 0:
            stack.pop()
        if stack:
            tree[stack[-1]][2 if tree[stack[-1]][2] < 0 else 3] = len(tree)

    def scores(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros(len(x))
        for t in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := np.flatnonzero(t[node, 0] >= 0)).size:
                at = t[node[inner]]
                left = x[inner, at[:, 0].astype(np.int64)] <= at[:, 1]
                node[inner] = np.where(left, at[:, 2], at[:, 3]).astype(np.int64)
            votes += t[node, 4]
        return votes / max(1, len(self.trees))


def fit(docs: DataFrame, words, text_col: str = "text", train_findings: int = TRAIN_FINDINGS) -> Forest | None:
    """A forest on a bounded sample of the labelled findings; None without findings of both labels.

    The sample holds the distinct labelled findings with the smallest SHA-256,
    half of them of each label at most, in that order, so reruns agree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"key": [], "label": [], "features": []}
            for t in b.column(0):
                text = t.as_py() or ""
                for start, end in findings(text):
                    label, x = describe(text, start, end, words.value)
                    if label is not None:
                        out["key"].append(hashlib.sha256(text[max(0, start - NEAR) : end + 2].encode()).hexdigest())
                        out["label"].append(float(label))
                        out["features"].append(x)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(out["key"], pa.string()), "label": pa.array(out["label"], pa.float64()),
                "features": pa.array(out["features"], pa.list_(pa.float64()))})

    labelled = docs.select(F.col(text_col).cast("string")).mapInArrow(
        run, "key string, label double, features array<double>")
    labelled = materialize(labelled.dropDuplicates(["key"]), "labelled-findings")
    half = [labelled.where(F.col("label") == y).orderBy("key").limit(train_findings // 2) for y in (0.0, 1.0)]
    sample = materialize(half[0].unionByName(half[1]).orderBy("key").coalesce(1), "training-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="x", labelCol="label")
    model = forest.fit(sample.withColumn("x", array_to_vector("features")).select("label", "x").coalesce(1))
    return Forest(model.toDebugString)


def _judge(forest: Forest | None, text: str, words: set[str]) -> list[tuple[int, int, int | None, float]]:
    spans = list(findings(text))
    if not spans:
        return []
    found = [describe(text, a, b, words) for a, b in spans]
    if forest is None:
        scores = [float(label or 0) for label, _ in found]
    else:
        scores = forest.scores(np.array([x for _, x in found])).tolist()
    return [(a, b, label, s) for (a, b), (label, _), s in zip(spans, found, scores)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: str = WORD_LIST,
         accept: float = ACCEPT) -> DataFrame:
    """One row per finding: doc_id, start_pos, end_pos, rule, score, is_secret, finding_sha256.

    Positions are characters of the whole text, end excluded; rule is the
    label that a rule gives (null if none does); score is the share of trees
    that vote for a secret.  Without labelled findings of both kinds there is
    no forest and the rules decide.  Null and blank texts have no findings;
    repeated rows and a null doc_id give findings like others.  Other columns
    are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(word_list(words))
    model = spark.sparkContext.broadcast(fit(docs, known, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                rows += [(i, a, e, label, s, s >= accept, hashlib.sha256(text[a:e].encode()).hexdigest())
                         for a, e, label, s in _judge(model.value, text, known.value)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.string())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["doc_id", "start_pos", "end_pos", "rule", "score", "is_secret", "finding_sha256"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start_pos long, end_pos long, rule int, score double, is_secret boolean, "
                                "finding_sha256 string")


def redact(docs: DataFrame, text_col: str = "text", words: str = WORD_LIST, accept: float = ACCEPT,
           mask: str = MASK) -> DataFrame:
    """``docs`` with every confirmed secret of the text replaced by ``mask``; all rows and columns stay."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(word_list(words))
    model = spark.sparkContext.broadcast(fit(docs, known, text_col))
    at, name = docs.columns.index(text_col), free_name(docs.columns, "redacted")
    names = [*docs.columns, name]

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for a, b, _, s in _judge(model.value, text, known.value):
            if s >= accept:
                out += [text[last:a], mask]
                last = b
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t.as_py()) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=names)

    done = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
    return done.select(*[F.col(name).alias(c) if c == text_col else F.col(c) for c in docs.columns])
