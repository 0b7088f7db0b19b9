"""DuckDB oracle text: the fixture mapping and the retail stages in plain SQL.

``prelude()`` returns a ``WITH`` list defining the retail tables over the
driver's views (part, orders, lineitem, embeddings); each oracle query appends
its own CTEs and final SELECT.  Names start with ``r_`` so they never shadow
the driver's views.
"""

from __future__ import annotations

from cartwise.sources.testdata import ATTRIBUTE_GAP, DEPARTMENT_TYPES, PRICE_GAP


def h(*keys: str, seed: str = "42") -> str:
    """SQL twin of ``cartwise.functions.expr.unit_hash``."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _dept_case(col: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(DEPARTMENT_TYPES, start=1))
    return f"CAST(CASE {col} {whens} END AS INTEGER)"


def _xsum(col: str) -> str:
    """SQL twin of ``exact_sum``."""
    return f"CAST(sum(CAST({col} AS DECIMAL(18,4))) AS DOUBLE)"


def _xavg(col: str) -> str:
    """SQL twin of ``exact_avg``."""
    return f"({_xsum(col)} / CAST(count({col}) AS DOUBLE))"


_PRELUDE = f"""
r_products AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id, p_name AS product_name,
         CAST(substr(p_brand, 7, 10) AS INTEGER) AS aisle_id,
         {_dept_case('p_type')} AS department_id
  FROM part),
r_aisles AS (
  SELECT DISTINCT CAST(substr(p_brand, 7, 10) AS INTEGER) AS aisle_id, p_brand AS aisle FROM part),
r_departments AS (
  SELECT DISTINCT {_dept_case('p_type')} AS department_id, p_type AS department FROM part),
r_orders AS (
  SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_custkey AS BIGINT) AS user_id,
         CAST(row_number() OVER w AS INTEGER) AS order_number,
         CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow,
         CAST(o_orderkey % 24 AS INTEGER) AS order_hour_of_day,
         CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE)
           AS days_since_prior_order
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r_lines0 AS (
  SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_partkey AS BIGINT) AS product_id,
         CAST(min(l_linenumber) AS INTEGER) AS add_to_cart_order
  FROM lineitem GROUP BY 1, 2),
r_lines AS (
  SELECT l.order_id, l.product_id, l.add_to_cart_order,
         CAST(o.order_number > min(o.order_number) OVER (PARTITION BY o.user_id, l.product_id) AS INTEGER)
           AS reordered,
         o.order_number = max(o.order_number) OVER (PARTITION BY o.user_id) AS is_train
  FROM r_lines0 l JOIN r_orders o ON l.order_id = o.order_id),
r_prior AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM r_lines WHERE NOT is_train),
r_train AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM r_lines WHERE is_train),
r_prices AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(p_retailprice AS DOUBLE) AS price
  FROM part WHERE p_partkey % {PRICE_GAP} <> 0),
r_attrs AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id,
         CAST(p_partkey % 11 AS DOUBLE) AS premium_score,
         CAST((p_partkey * 3) % 11 AS DOUBLE) AS necessity_score,
         CAST((p_partkey * 5) % 11 AS DOUBLE) AS impulse_score,
         CAST((p_partkey * 7) % 11 AS DOUBLE) AS cross_sell_score,
         CAST(p_partkey % 2 AS INTEGER) AS is_food,
         CAST(p_retailprice AS DOUBLE) AS price
  FROM part WHERE p_partkey % {ATTRIBUTE_GAP} <> 0),
r_emb AS (SELECT CAST(vec_id AS BIGINT) AS product_id, embedding FROM embeddings),
r_product_dim AS (
  SELECT p.product_id, p.product_name, p.aisle_id, p.department_id, a.aisle, d.department
  FROM r_products p JOIN r_aisles a ON p.aisle_id = a.aisle_id
  JOIN r_departments d ON p.department_id = d.department_id),
r_products_full AS (
  SELECT p.*, pr.price FROM r_product_dim p LEFT JOIN r_prices pr ON p.product_id = pr.product_id),
r_lines_all AS (SELECT * FROM r_prior UNION ALL SELECT * FROM r_train),
r_merged AS (
  SELECT l.order_id, l.product_id, l.add_to_cart_order, l.reordered,
         o.user_id, o.order_number, o.order_dow, o.order_hour_of_day, o.days_since_prior_order,
         p.product_name, p.aisle_id, p.department_id, p.aisle, p.department, p.price
  FROM r_lines_all l JOIN r_orders o ON l.order_id = o.order_id
  JOIN r_products_full p ON l.product_id = p.product_id),
r_imputed AS (
  SELECT * REPLACE (
           coalesce(days_since_prior_order, 0.0::DOUBLE) AS days_since_prior_order,
           coalesce(price, (SELECT median(price) FROM r_merged)) AS price)
  FROM r_merged),
r_user_stats AS (
  SELECT user_id, count(product_id) AS average_basket_size, max(order_number) AS purchase_frequency,
         {_xavg('price')} AS user_avg_order_value, {_xsum('price')} AS user_total_spent
  FROM r_imputed GROUP BY user_id),
r_product_stats AS (
  SELECT product_id, avg(reordered) AS product_reorder_rate, {_xsum('price')} AS product_revenue_contribution
  FROM r_imputed GROUP BY product_id),
r_up_stats AS (
  SELECT user_id, product_id, max(order_number) AS product_last_ordered FROM r_imputed GROUP BY 1, 2),
r_features AS (
  SELECT m.*, u.average_basket_size, u.purchase_frequency, u.user_avg_order_value, u.user_total_spent,
         ps.product_reorder_rate, ps.product_revenue_contribution, up.product_last_ordered,
         u.purchase_frequency - m.order_number AS order_recency
  FROM r_imputed m JOIN r_user_stats u ON m.user_id = u.user_id
  JOIN r_product_stats ps ON m.product_id = ps.product_id
  JOIN r_up_stats up ON m.user_id = up.user_id AND m.product_id = up.product_id)
"""


def sql(body: str, ctes: str = "") -> str:
    """Full oracle statement: prelude CTEs, optional extra CTEs, final SELECT."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {_PRELUDE.strip()}{extra}\n{body.strip()}"


def round_cols(inner: str, cols: list[str], digits: int = 6) -> str:
    """Wrap a SELECT so the listed double columns are rounded like the Spark side."""
    if not cols:
        return inner
    rep = ", ".join(f"CASE WHEN abs({c}) < 1 THEN CAST(CAST({c} AS FLOAT) AS DOUBLE) ELSE round({c}, {digits}) END AS {c}"
                    for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner.strip()}) AS _q"


def r2(expr: str) -> str:
    """SQL twin of ``round2``: rint(x * 100) / 100 on the double value."""
    return f"(round_even(({expr}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE)"
