"""Registered queries: enrichment request / reply jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwise.operators import enrich, prep
from cartwise.plans.oracle import round_cols, sql
from cartwise.plans.q_prep import merged, tables
from cartwise.plans.registry import register
from cartwise.session import materialize, stage_folder
from cartwise.sources import testdata
from cartwise.sources.done_store import DoneStore


def lit_sql(text: str) -> str:
    """A Python string as a DuckDB expression (newlines as chr(10))."""
    parts = text.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def _batched(src: str, size: int) -> str:
    return (f"SELECT product_id, product_name, CAST((rn - 1) // {size} AS BIGINT) AS batch_id, "
            f"CAST((rn - 1) % {size} + 1 AS INTEGER) AS pos "
            f"FROM (SELECT *, row_number() OVER (ORDER BY product_id) AS rn FROM {src})")


_NUM = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
_REST = r"regexp_replace(regexp_replace(line, '^[^.]*\.', ''), '^\s+|\s+$', '', 'g')"
_CLEAN = f"replace(replace({_REST}, '$', ''), ',', '')"

ENRICH_CTES = rf"""
r_pm AS ({_batched("(SELECT product_id, product_name FROM r_products)", enrich.PRICE_BATCH)}),
r_preq AS (
  SELECT batch_id, count(*) AS n_items, arg_min(product_id, pos) AS first_product_id,
         arg_max(product_id, pos) AS last_product_id,
         {lit_sql(enrich.PRICE_PROMPT)} || string_agg(pos || '. ' || product_name, chr(10) ORDER BY pos) AS request
  FROM r_pm GROUP BY batch_id),
r_pline AS (
  SELECT m.batch_id, m.pos,
         CASE m.product_id % 5
           WHEN 0 THEN m.pos || '. $' || format('{{:,.2f}}', p.p_retailprice)
           WHEN 1 THEN m.pos || '. n/a'
           WHEN 2 THEN CAST(p.p_retailprice AS VARCHAR)
           WHEN 3 THEN m.pos || '. ' || CAST(p.p_retailprice AS VARCHAR)
           ELSE m.pos || '. $' || CAST(p.p_retailprice AS VARCHAR) END AS line,
         max(m.pos) OVER (PARTITION BY m.batch_id) AS last
  FROM r_pm m JOIN part p ON m.product_id = p.p_partkey),
r_prep AS (
  SELECT batch_id, string_agg(line, chr(10) ORDER BY pos) AS reply FROM r_pline
  WHERE NOT (batch_id % 7 = 3 AND pos = last) GROUP BY batch_id),
r_plines AS (
  SELECT batch_id, unnest(string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), chr(10))) AS line,
         CAST(generate_subscripts(string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), chr(10)), 1)
              AS INTEGER) AS pos
  FROM r_prep),
r_pparsed AS (
  SELECT batch_id, pos,
         CASE WHEN regexp_full_match({_CLEAN}, '{_NUM}') THEN CAST({_CLEAN} AS DOUBLE) ELSE 0.0 END AS price
  FROM r_plines),
r_pprice AS (
  SELECT m.product_id, m.product_name, m.batch_id, m.pos, x.price
  FROM r_pm m LEFT JOIN r_pparsed x ON m.batch_id = x.batch_id AND m.pos = x.pos
  WHERE m.batch_id IN (SELECT batch_id FROM r_prep)),
r_top AS (SELECT product_id, count(*) AS n_lines FROM r_merged GROUP BY product_id ORDER BY product_id LIMIT 200),
r_topinfo AS (SELECT * FROM r_products_full WHERE product_id IN (SELECT product_id FROM r_top)),
r_cm AS ({_batched("(SELECT product_id, product_name FROM r_products)", enrich.CATEGORY_BATCH)}),
r_creq AS (
  SELECT batch_id, count(*) AS n_items, arg_min(product_id, pos) AS first_product_id,
         arg_max(product_id, pos) AS last_product_id,
         {lit_sql(enrich.CATEGORY_PROMPT_HEAD)} || string_agg(product_name, '; ' ORDER BY pos) AS request
  FROM r_cm GROUP BY batch_id),
r_ccat AS (
  SELECT m.batch_id, m.pos, lower(p.p_type) || '_' || substr(p.p_brand, 7, 10) AS cat,
         max(m.pos) OVER (PARTITION BY m.batch_id) AS last
  FROM r_cm m JOIN part p ON m.product_id = p.p_partkey),
r_crep AS (
  SELECT batch_id,
         string_agg(cat, ', ' ORDER BY pos) || CASE WHEN batch_id % 5 = 1 THEN ', extra_category' ELSE '' END
           AS reply
  FROM r_ccat WHERE NOT (batch_id % 5 = 2 AND pos = last) GROUP BY batch_id),
r_cparts AS (
  SELECT batch_id, unnest(string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), ',')) AS part,
         CAST(generate_subscripts(string_split(regexp_replace(reply, '^\s+|\s+$', '', 'g'), ','), 1) AS INTEGER)
           AS pos
  FROM r_crep),
r_cats AS (
  SELECT m.product_id, regexp_replace(c.part, '^\s+|\s+$', '', 'g') AS llm_category
  FROM r_cm m JOIN r_cparts c ON m.batch_id = c.batch_id AND m.pos = c.pos),
r_areq AS (
  SELECT DISTINCT p.product_id, p.product_name, d.department, a.aisle
  FROM r_products p LEFT JOIN r_departments d ON p.department_id = d.department_id
  LEFT JOIN r_aisles a ON p.aisle_id = a.aisle_id),
r_arep AS (
  SELECT CAST(p.p_partkey AS BIGINT) AS product_id,
         CASE WHEN a.product_id IS NOT NULL THEN
           '{{"premium_score":' || CAST(a.premium_score AS VARCHAR) || ',"necessity_score":'
           || CAST(a.necessity_score AS VARCHAR) || ',"impulse_score":' || CAST(a.impulse_score AS VARCHAR)
           || ',"cross_sell_score":' || CAST(a.cross_sell_score AS VARCHAR) || ',"is_food":'
           || CAST(a.is_food AS VARCHAR) || ',"price":' || CAST(a.price AS VARCHAR) || '}}'
         ELSE '{{"premium_score": ' END AS reply
  FROM part p LEFT JOIN r_attrs a ON p.p_partkey = a.product_id),
r_aok0 AS (
  SELECT product_id, CASE WHEN coalesce(json_valid(reply), false) THEN CAST(reply AS JSON) END AS j FROM r_arep),
r_aok AS (
  SELECT product_id, j AS reply,
         j IS NOT NULL
         AND (j->>'premium_score') IS NOT NULL AND (j->>'necessity_score') IS NOT NULL
         AND (j->>'impulse_score') IS NOT NULL AND (j->>'cross_sell_score') IS NOT NULL
         AND (j->>'is_food') IS NOT NULL AND (j->>'price') IS NOT NULL AS ok
  FROM r_aok0)
"""


def price_members(spark, sf_dir):
    t = tables(spark, sf_dir)
    return enrich.price_requests(t["products"])


def parsed_prices(spark, sf_dir):
    members, _ = price_members(spark, sf_dir)
    replies = testdata.price_replies(spark, sf_dir, members)
    return enrich.parse_price_replies(replies, members)


@register("build_price_requests", sql("SELECT * FROM r_preq", ENRICH_CTES))
def q_build_price_requests(spark, sf_dir):
    """M1 request job: numbered name lists, 500 products per batch."""
    return price_members(spark, sf_dir)[1]


@register("parse_price_reply", sql(round_cols("SELECT * FROM r_pprice", ["price"]), ENRICH_CTES))
def q_parse_price_reply(spark, sf_dir):
    """M1 reply job: reply line N prices member N."""
    return parsed_prices(spark, sf_dir)


@register("enrich_pending", sql("""
SELECT product_id, product_name FROM r_products
WHERE product_id NOT IN (SELECT product_id FROM r_pprice WHERE batch_id >= 2 AND price IS NOT NULL)""", ENRICH_CTES))
def q_enrich_pending(spark, sf_dir):
    """A4 + B1 + D12: products still to price after all but two batches were stored, one reply being short."""
    done = enrich.priced(parsed_prices(spark, sf_dir)).where(F.col("batch_id") >= 2).select("product_id", "price")
    store = DoneStore(spark, stage_folder(spark, "done-store"), done.schema)
    store.append("all-but-two", materialize(done, "priced"))
    return store.pending(tables(spark, sf_dir)["products"].select("product_id", "product_name"))


def top_info(spark, sf_dir):
    t = tables(spark, sf_dir)
    prods = prep.attach_prices(prep.product_dim(t["products"], t["aisles"], t["departments"]), t["product_prices"])
    return prods.join(enrich.top_products(merged(spark, sf_dir), 200).select("product_id"), "product_id",
                      "left_semi")


@register("top_products_info", sql(round_cols("SELECT * FROM r_topinfo", ["price"]), ENRICH_CTES))
def q_top_products_info(spark, sf_dir):
    """G6 + E4 + C7: the reference's 200 'top' products (smallest ids with lines)."""
    return top_info(spark, sf_dir)


def category_members(spark, sf_dir):
    return enrich.category_requests(tables(spark, sf_dir)["products"])


@register("build_category_requests", sql("SELECT * FROM r_creq", ENRICH_CTES))
def q_build_category_requests(spark, sf_dir):
    """M2 request job: 20 names per batch."""
    return category_members(spark, sf_dir)[1]


@register("parse_category_reply", sql("SELECT * FROM r_cats", ENRICH_CTES))
def q_parse_category_reply(spark, sf_dir):
    """M2 reply job: comma part N is the category of member N."""
    members, _ = category_members(spark, sf_dir)
    return enrich.parse_category_replies(testdata.category_replies(spark, sf_dir, members), members)


@register("build_attribute_requests", sql(f"""
SELECT *, printf({lit_sql(enrich.ATTRIBUTE_PROMPT)}, product_name, department, aisle) AS request FROM r_areq""",
                                          ENRICH_CTES))
def q_build_attribute_requests(spark, sf_dir):
    """M3 request job: one prompt per distinct product."""
    t = tables(spark, sf_dir)
    return enrich.attribute_requests(t["products"], t["departments"], t["aisles"])


_D = enrich.DEFAULT_ATTRIBUTES


@register("parse_attribute_reply", sql(round_cols(f"""
SELECT product_id,
  CASE WHEN ok THEN CAST(reply->>'premium_score' AS DOUBLE) ELSE {_D['premium_score']} END AS premium_score,
  CASE WHEN ok THEN CAST(reply->>'necessity_score' AS DOUBLE) ELSE {_D['necessity_score']} END AS necessity_score,
  CASE WHEN ok THEN CAST(reply->>'impulse_score' AS DOUBLE) ELSE {_D['impulse_score']} END AS impulse_score,
  CASE WHEN ok THEN CAST(reply->>'cross_sell_score' AS DOUBLE) ELSE {_D['cross_sell_score']} END
    AS cross_sell_score,
  CASE WHEN ok THEN CAST(reply->>'is_food' AS INTEGER) ELSE {_D['is_food']} END AS is_food,
  CASE WHEN ok THEN CAST(reply->>'price' AS DOUBLE) ELSE {_D['price']} END AS price,
  NOT ok AS is_default
FROM r_aok""", ["premium_score", "necessity_score", "impulse_score", "cross_sell_score", "price"]), ENRICH_CTES))
def q_parse_attribute_reply(spark, sf_dir):
    """M3 reply job: typed JSON parse with the default record on failure."""
    return enrich.parse_attribute_replies(testdata.attribute_replies(spark, sf_dir))
