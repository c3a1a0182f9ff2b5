"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def off_edge(digits: int) -> float:
    """Added before rounding on both sides: ratios of small numbers often end exactly on a rounding edge, where the
    last bit of a sum would decide."""
    return 0.00037 * 10.0**-digits


def near(value: Column | str, digits: int = DIGITS) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(off_edge(digits)), digits)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(
        *[near(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    )


def r(expression: str, digits: int = DIGITS) -> str:
    """The same rounding in SQL, without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE) + CAST({off_edge(digits)!r} AS DOUBLE), {digits}) + 0.0)"


DEMAND = """
demand AS (
  SELECT r_name AS region, printf('SKU-%06d', l_partkey) AS sku, l_partkey AS sku_n,
         CAST(l_shipdate AS DATE) AS date, printf('PROD_%03d', l_partkey % 50 + 1) AS product_id,
         CAST(l_quantity AS INTEGER) AS demand, l_extendedprice / l_quantity AS price,
         CAST(isodow(l_shipdate) - 1 AS INTEGER) AS day_of_week, l_discount >= CAST(0.08 AS DOUBLE) AS promotion,
         p_size * 20 AS inventory, l_orderkey % 5 = 0 AS holdout
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""

COEFS = DEMAND + """,
coef AS (
  SELECT region, sku_n, count(*) AS n_train, avg(demand) AS mean,
         CASE WHEN min(price) < max(price) THEN regr_intercept(demand, price) ELSE avg(demand) END AS intercept,
         CASE WHEN min(price) < max(price) THEN regr_slope(demand, price) ELSE 0.0 END AS slope
  FROM demand WHERE NOT holdout GROUP BY region, sku_n
),
weekday AS (
  SELECT region, sku_n, day_of_week, avg(demand) AS day_mean
  FROM demand WHERE NOT holdout GROUP BY region, sku_n, day_of_week
),
guess AS (
  SELECT d.region, d.sku_n, d.sku, d.price, d.day_of_week, d.promotion, d.inventory, d.holdout, CAST(d.demand AS DOUBLE) AS y,
         round(c.mean, 6) AS p_mean, round(c.intercept + c.slope * d.price, 6) AS p_ols,
         round(coalesce(w.day_mean, c.mean), 6) AS p_day
  FROM demand d JOIN coef c ON d.region = c.region AND d.sku_n = c.sku_n
  LEFT JOIN weekday w ON d.region = w.region AND d.sku_n = w.sku_n AND d.day_of_week = w.day_of_week
  WHERE d.holdout
)"""

TELEMETRY = COEFS + """,
tried AS (
  SELECT region, sku_n, 'mean' AS model_name, y, p_mean AS p FROM guess
  UNION ALL SELECT region, sku_n, 'price_ols', y, p_ols FROM guess
  UNION ALL SELECT region, sku_n, 'weekday_mean', y, p_day FROM guess
),
measured AS (
  SELECT region, sku_n, model_name, n,
         sqrt(sse / n) AS rmse, share / n AS mape, CASE WHEN varied THEN 1 - sse / spread END AS r2,
         sae / n AS mae, sse / n AS mse, hits / n AS accuracy, tp, fp, fn
  FROM (
    SELECT region, sku_n, model_name, count(*) AS n, var_pop(y) * count(*) AS spread, min(y) < max(y) AS varied,
           CAST(sum(CAST((y - p) * (y - p) AS DECIMAL(30, 8))) AS DOUBLE) AS sse,
           CAST(sum(CAST(abs(y - p) AS DECIMAL(30, 8))) AS DOUBLE) AS sae,
           CAST(sum(CAST(abs(y - p) / y AS DECIMAL(30, 12))) AS DOUBLE) AS share,
           count(*) FILTER (abs(y - p) / y <= CAST(0.25 AS DOUBLE)) AS hits, count(*) FILTER (y > 25 AND p > 25) AS tp,
           count(*) FILTER (y <= 25 AND p > 25) AS fp, count(*) FILTER (y > 25 AND p <= 25) AS fn
    FROM tried GROUP BY region, sku_n, model_name)
),
model_names AS (SELECT unnest(['mean', 'price_ols', 'weekday_mean']) AS model_name),
telemetry AS (
  SELECT c.region, printf('SKU-%06d', c.sku_n) AS sku, c.sku_n, m.model_name, c.n_train, coalesce(e.n, 0) AS n_holdout,
         rmse, mape, r2, mae, mse, accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1,
         c.mean, c.intercept, c.slope
  FROM coef c CROSS JOIN model_names m
  LEFT JOIN measured e ON e.region = c.region AND e.sku_n = c.sku_n AND e.model_name = m.model_name
),
best AS (
  SELECT * FROM telemetry WHERE rmse IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY region, sku ORDER BY rmse, mape NULLS LAST, model_name) = 1
),
served AS (
  SELECT region, sku, sku_n, model_name FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY region, sku
    ORDER BY rmse NULLS LAST, mape NULLS LAST, model_name) = 1
)"""


def run_id(*parts: str) -> str:
    return "md5(concat_ws('/', " + ", ".join(parts) + "))"
