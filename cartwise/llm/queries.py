"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm import (
    centroids, decontaminate, embedding_dedup, lexical, lm, mixing, quality, secret_scan, simhash, substring_dedup,
    token_counts, token_store, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram with suffix sums of all documents."""
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s
), f AS (
  SELECT *, sum(source_size) OVER () AS all_size,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), g AS (
  SELECT *, 1.5::DOUBLE * all_size::DOUBLE - 2.0::DOUBLE * before_size::DOUBLE AS left_over FROM f
), h AS (
  SELECT *, weight * left_over >= 2 * source_size * open_weight AS is_full FROM g
), level AS (
  SELECT open_weight, left_over FROM h WHERE NOT is_full ORDER BY open_weight DESC LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN 2.0::DOUBLE * source_size
              ELSE weight * (SELECT left_over FROM level) / (SELECT open_weight FROM level)::DOUBLE END::DOUBLE AS target FROM h
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS passed
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, r.round, (passed + r.round * source_size)::DOUBLE / target AS finish
  FROM p, (VALUES (0), (1)) r(round) WHERE size > 0 AND target > 0
), q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, passed
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c
), k AS (
  SELECT source, passed, size, sum(greatest(0, least(size, floor(1.5 * (SELECT sum(size) FROM d))::BIGINT - upto + size)))::BIGINT AS taken
  FROM q GROUP BY source, passed, size
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN k ON p.source IS NOT DISTINCT FROM k.source AND p.passed = k.passed AND p.size = k.size
"""


@query("op4_mixing", MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), b AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
         min(page_id) OVER (PARTITION BY body) AS first_id FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""


@query("op10_warc", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, normalise them and read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTAIN_SQL = rf"""
WITH i AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ig AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n,
         unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k + 1:k + 5], ' '))) AS g
  FROM i WHERE len(w) > 0
), q AS (
  SELECT item_id, n, count(*) AS c FROM ig GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), dg AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' '))) AS g
  FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n
)
SELECT doc_id, item_id, q.c::INT AS n_shingles, count(*)::INT AS n_found, count(*)::DOUBLE / q.c AS containment
FROM ig JOIN dg USING (n, g) JOIN q USING (item_id)
GROUP BY doc_id, item_id, q.c HAVING count(*)::DOUBLE / q.c >= 0.8::DOUBLE
"""


@query("op2_decontaminate", CONTAIN_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a
), c AS (
  SELECT id, min(other) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op7_embedding_dedup", COSINE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


SPAN_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20
), g AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s + 1:s + 20], ' ') ORDER BY doc_id, s) AS k FROM p
), x AS (
  SELECT DISTINCT doc_id, s + unnest(range(20)) AS word FROM g WHERE k > 1
), y AS (
  SELECT doc_id, count(*) AS n, list(word) AS gone FROM x GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(y.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda v, k: y.gone IS NULL OR NOT list_contains(y.gone, k - 1)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id
"""


@query("op8_substring_dedup", SPAN_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows of all documents removed."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return lm.score(table(spark, sf_dir, "documents"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents with the forest's verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def _round_sql(k: int) -> str:
    """Assignment ``a{k}`` by the centroids ``c{k}``, and the centroids after it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT v.rid, v.vec_id, v.v, c.c,
           list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM v, c{k} c
  ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
), m{k} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(range(64)) AS i, unnest(v) AS x FROM a{k}) GROUP BY c, i
  ) GROUP BY c
), c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} ON c{k}.c = m{k}.c
),"""


CENTROID_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < 16
),{_round_sql(0)}{_round_sql(1)}{_round_sql(2)}{_round_sql(3)}
t AS (
  SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a3 GROUP BY c
)
SELECT a3.vec_id, a3.c::INT AS cluster, a3.d AS distance, t.cluster_inertia,
       (SELECT sum(d)::BIGINT FROM a3) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN t ON a3.c = t.c JOIN c3 ON a3.c = c3.c
"""


@query("op11_centroids", CENTROID_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings with 64 finite components."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS w, len(w)::BIGINT AS n FROM documents
), s AS (
  SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM d WHERE n > 0
), i AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark
), f AS MATERIALIZED (
  SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY rid, term
), w AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), s
), p AS (
  SELECT f.rid, f.term, w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * d.n * s.all_docs) // s.all_terms))) AS part
  FROM f JOIN w ON f.term = w.term JOIN d ON f.rid = d.rid, s
), q AS (
  SELECT i.item_id, p.rid, sum(p.part)::BIGINT AS score FROM i JOIN p ON i.term = p.term GROUP BY i.item_id, p.rid
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM q JOIN d ON q.rid = d.rid WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_lexical_search", SEARCH_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_store")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files and read back."""
    return token_store.round_trip(table(spark, sf_dir, "documents"))
