"""Centroid clustering, ranked lexical search and the token store against plain loops."""

from __future__ import annotations

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, lower
from hypothesis import given, settings
from hypothesis import strategies as st

from cartwise.llm import centroids, huffman, lexical, queries, token_store

VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        own = [min((gap(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if step == rounds:
            break
        for n in range(len(centres)):
            members = [v for (_, v), (_, m) in zip(kept, own) if m == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members)]
    total = Counter()
    for d, n in own if kept else []:
        total[n] += d
    return sorted(
        ((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
         for (i, _), (d, n) in zip(kept, own)), key=repr) if kept else []


def test_clusters_match_plain_loops(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.2, 8).tolist()) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(60)]  # a hot copy
    rows += [rows[4], rows[4], (None, rows[7][1]), (None, [0.0] * 8), (301, None), (302, []), (303, [1.0] * 7),
             (304, [None] + [1.0] * 7), (305, [float("nan")] * 8), (306, [float("inf")] * 8), (307, [-0.001] * 8)]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], VECTORS).repartition(5)
    got = sorted((tuple(x) for x in centroids.cluster(df, clusters=6, components=8).collect()), key=repr)
    assert got == plain_clusters(rows, 6, 3, 8)


def test_clusters_of_few_or_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(empty).collect() == []
    one = spark.createDataFrame([(5, [1.0, 2.0], 1, "x")], VECTORS)
    assert [r[:5] for r in centroids.cluster(one, components=2).collect()] == [(5, 0, 0, 0, 0)]
    with pytest.raises(Exception, match="larger than"):
        centroids.cluster(spark.createDataFrame([(5, [1e30, 2.0], 1, "x")], VECTORS), components=2).collect()


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_segment_dictionaries_lose_nothing(width):
    r = np.random.default_rng(width)
    v = r.integers(-3, 3, (500, 16))
    v[:200] = v[0]
    got, codes, entries = centroids.encode_segment(v, (width,))
    assert got == width
    assert (np.concatenate([e[c] for c, e in zip(codes, entries)], axis=1) == v).all()
    row = (b"".join(c.tobytes() for c in codes), np.array([len(e) for e in entries], np.int32).tobytes(),
           b"".join(e.astype(np.int32).tobytes() for e in entries))
    s = centroids.Segment(500, width, *row)
    c = r.integers(-3, 3, (7, 16))
    full = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    cluster, distance = s.nearest(c)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    n, sums = s.sums(cluster, 7)
    assert (n == np.bincount(cluster, minlength=7)).all()
    assert all((sums[k] == v[cluster == k].sum(axis=0)).all() for k in range(7))


def test_segments_are_cut_and_cover_all(spark):
    rows = [(i, [float(i % 5), float(i % 3)], 1, "x") for i in range(250)]
    found = centroids.encode(centroids.integer_vectors(spark.createDataFrame(rows, VECTORS).coalesce(1), 2), 64)
    assert sorted(len(r["vec_ids"]) for r in found.collect()) == [58, 64, 64, 64]
    assert sorted(i for r in found.collect() for i in r["vec_ids"]) == list(range(250))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, top=10):
    texts = [(r[0], Counter(TERM.findall(lower(r[1] or "")))) for r in rows]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    by_id: dict = {}
    for i, text in items:
        by_id.setdefault(i, set()).update(TERM.findall(lower(text or "")))
    out = []
    for item, own in by_id.items():
        scored = []
        for i, c, n in texts:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in own if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha beta gamma"), (2, "ÉTÉ été Zeta9"), (3, "common"), (4, None), (5, "  ... "), (None, "beta delta"),
         (6, "nowhere at all"), (1, "alpha beta gamma"), (7, "alpha epsilon " * 40)]


def corpus():
    r = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "common", "ÉTÉ", "été", "zeta9", "x_y", "filler", "words", "epsilon"]
    rows = [(i, " ".join(r.choice(vocabulary, r.integers(0, 30)))) for i in range(120)]
    rows += [(200 + i, "alpha common") for i in range(60)]  # ties: one group of copies
    rows += [(200, "alpha common"), (300, None), (301, ""), (302, " .,; "), (None, "alpha beta"), (None, "alpha common")]
    return rows + [(400, "common " * 150_000 + "alpha"), (401, "a" * 300_000 + " beta")]


@pytest.mark.parametrize("entries", [1_000_000, 3])
def test_search_matches_plain_loops(spark, entries):
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id")
    found = lexical.search(docs(spark, rows, extra=True).repartition(6), items, block_entries=entries)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(x) for x in found.collect()), key=repr) == plain_search(rows, ITEMS)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs(spark, []), items).collect() == []
    assert lexical.search(docs(spark, corpus()[:5]), items.limit(0)).collect() == []


def test_sums_beyond_doubles_are_exact():
    index = lexical.Index(["i"], [["a", "b"]])
    index.split = True
    value = np.array([(1 << 60) + 1, 3], dtype=np.int64)
    assert index.scores(np.array([0, 0]), np.array([0, 1]), value, 1).tolist() == [[(1 << 60) + 4]]


def test_heaps_keep_the_best_whatever_the_order():
    r = np.random.default_rng(1)
    scores, ids = r.integers(0, 9, (400, 3)), [None if i % 50 == 0 else int(i) for i in r.permutation(400)]
    for step in (1, 7, 400):
        heaps = lexical.Heaps(3, 10)
        for at in range(0, 400, step):
            heaps.update(scores[at : at + step], ids[at : at + step])
        for item in range(3):
            best = sorted((-int(s), i is None, i or 0) for s, i in zip(scores[:, item], ids) if s > 0)[:10]
            got = sorted((-s, d is None, d or 0) for i, d, s in heaps.rows() if i == item)
            assert got == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=300), st.integers(1, 18))
def test_codes_are_canonical_limited_and_complete(counts, bits):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, bits)
    used = lengths[lengths > 0].astype(int)
    assert ((lengths > 0) == (counts > 0)).all()
    if len(used) > 1:
        assert sum(2.0**-x for x in used) == 1 and used.max() <= max(bits, (len(used) - 1).bit_length())
    code = huffman.Code(lengths)
    words = sorted((int(n), s, format(int(code.codes[s]), f"0{n}b")) for s, n in enumerate(lengths) if n)
    assert [w for _, _, w in words] == sorted(w for _, _, w in words)
    assert not any(b.startswith(a) for (_, _, a), (_, _, b) in zip(words, words[1:]))


def test_code_lengths_are_the_best():
    import itertools

    for counts in ([1, 1, 2, 3, 5, 8], [100, 1, 1, 1, 1, 1], [4, 4, 4, 4, 4, 4]):
        for bits in (3, 4, 5):
            best = min(sum(c * n for c, n in zip(counts, lengths)) for lengths in itertools.product(range(1, bits + 1), repeat=6)
                       if sum(2.0**-n for n in lengths) <= 1)
            assert int((np.array(counts) * huffman.code_lengths(np.array(counts), bits)).sum()) == best


def a_file(ids, sizes, doc_ids, block):
    out = io.BytesIO()
    huffman.write_file(out, huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=700))), doc_ids, sizes, ids, block)
    return out.getvalue()


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_files_round_trip_in_any_range(block, monkeypatch):
    monkeypatch.setattr(huffman, "PIECE", 512)
    r = np.random.default_rng(block)
    sizes = np.array([0, 5, 1, 3000, 0, 994])
    ids = (r.zipf(1.4, 4000) % 700).astype(np.uint16)
    data = a_file(ids, sizes, [None, 4, 4, -9, 2**62, 0], block)
    reader = huffman.Reader(io.BytesIO(data))
    reader.check()
    for first, n in ((0, 4000), (0, 1), (3999, 1), (1023, 2), (500, 3000), (4000, 5), (3990, 100)):
        assert (reader.ids(first, n) == ids[first : first + n]).all()
    found = [(d, np.concatenate([*p, np.zeros(0, int)]).tolist()) for d, p in reader.documents()]
    ends = np.cumsum(sizes)
    assert found == [(d, ids[e - s : e].tolist()) for d, s, e in zip([None, 4, 4, -9, 2**62, 0], sizes, ends)]


def test_damaged_files_raise():
    data = a_file(np.arange(600) % 9, np.array([600]), [1], 64)
    huffman.Reader(io.BytesIO(data)).check()
    with pytest.raises(ValueError, match="checksum"):
        huffman.Reader(io.BytesIO(data[:-1])).check()
    with pytest.raises(ValueError, match="checksum"):
        huffman.Reader(io.BytesIO(data[:-3] + bytes([data[-3] ^ 1]) + data[-2:])).check()
    with pytest.raises(ValueError, match="not a file"):
        huffman.Reader(io.BytesIO(b"x" * 100))


ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "a  b", "　 a", "!\x1c !", "x\x1c\x1c  y", "<|endoftext|>",
       "a <|endoftext|> b", "a<|endoftext|>  b", "don't  stop", "é  è", "\n\n a\n\n", "ab\t c", "   x", "😀 😀  😀", "a\x85 b",
       "\x1f a", "a\x1f", "﻿ a b", "​  ᠎ x", "é" * 5000 + " " + "word " * 3000]


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(token_store.tokenizer_file())


def whole(encoder, texts):
    return [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def split(found):
    ids, sizes = found
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bc", " ", " ", "\n", " ", "\x1c", "1", "!", "'s", "　", "é", "😀", "\t",
                                           "\x85", "<|endoftext|>", "​", ".", "é.\n", "²", "don't", "_", "5", "ß,", "ж.", "×!"]), max_size=25).map("".join), min_size=1, max_size=8))
def test_pieces_give_the_library_s_ids(encoder, texts):
    assert split(encoder.encode(pa.array(texts, pa.string()))) == whole(encoder, texts)


def test_odd_texts_and_a_full_memory(encoder, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_IDS", 10)
    for _ in range(2):
        assert split(encoder.encode(pa.array([*ODD, None], pa.string()))) == whole(encoder, [*ODD, None])


def test_other_tokenizers_get_whole_texts():
    other = token_store.Encoder(token_store.tokenizer_file("word_bpe_49k.json"))
    assert not other.piecewise
    assert split(other.encode(pa.array(["Some  Words", None, "x"], pa.string()))) == whole(other, ["Some  Words", "", "x"])


def expected_store(encoder, rows):
    out, start = Counter(), 0
    for i, ids in sorted(zip((r[0] for r in rows), whole(encoder, [r[1] for r in rows])), key=lambda x: (x[0] is None, x[0] or 0)):
        ids = [*ids, 0]
        out[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    return out


def check_store(encoder, rows, found):
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected_store(encoder, rows)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda i: (i is None, i or 0))


def test_store_round_trip(spark, encoder):
    r = np.random.default_rng(2)
    rows = [(int(i), ODD[i % len(ODD)] + " " + " ".join(r.choice(["the", "quick", "Fuchs", "été"], 20))) for i in r.permutation(80)]
    rows += [(7, "same")] * 40 + [(7, "other"), (None, "no id"), (None, None), (90, None), (91, ""), (92, "x y " * 100_000)]
    found = token_store.round_trip(docs(spark, rows, extra=True).repartition(5))
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    check_store(encoder, rows, found.collect())


def test_small_files_keep_the_order(spark, encoder):
    rows = [(i, f"document {i} " * (i % 13)) for i in range(200)]
    staged, vocabulary = token_store.staged_ids(docs(spark, rows), file_ids=100)
    files = token_store.write(staged, vocabulary, token_store.store_root(spark), block=16)
    assert files.count() > 20
    found = token_store.read(files).collect()
    check_store(encoder, rows, found)
    by_id = dict(zip(range(200), whole(encoder, [t for _, t in rows])))
    assert all(r["ids"] == [*by_id[r["doc_id"]], 0] for r in found)


def test_store_of_an_empty_table(spark):
    assert token_store.round_trip(docs(spark, [])).collect() == []


def test_query_encodes_the_table(spark, encoder):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_store(encoder, rows, queries.QUERIES["op13_token_store"](spark, sf).collect())
