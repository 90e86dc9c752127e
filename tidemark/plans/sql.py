"""The panels of ``sources.panels`` as DuckDB common table expressions, which the oracles start from."""

from __future__ import annotations


def _panel(name: str, asset: str) -> str:
    return f"""{name}_lines AS (
      SELECT {asset} AS asset, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS price, l_quantity AS q,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey, l_linenumber, l_partkey, l_extendedprice
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
    {name} AS (
      SELECT asset, dt, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, q) AS open, max(price) AS high,
        min(price) AS low, CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE / sum(q) AS close, sum(q) AS volume
      FROM {name}_lines GROUP BY asset, dt)"""


BARS = _panel("bars", "p_brand")
TYPES = _panel("types", "p_type")
#: bars with the day's return and the row's number from 1.
RETS = BARS + """,
    rets AS (
      SELECT *, close / lag(close) OVER w - 1 AS ret, row_number() OVER w AS rn, count(*) OVER (PARTITION BY asset) AS n
      FROM bars WINDOW w AS (PARTITION BY asset ORDER BY dt))"""
TYPE_RETS = TYPES + """,
    trets AS (
      SELECT asset AS benchmark, dt, close AS level, close / lag(close) OVER w - 1 AS bret
      FROM types WINDOW w AS (PARTITION BY asset ORDER BY dt))"""
SERIES = TYPES + """,
    series AS (
      SELECT CASE asset WHEN 'ECONOMY' THEN 'gold' WHEN 'STANDARD' THEN 'equity' WHEN 'SMALL' THEN 'vix'
        WHEN 'MEDIUM' THEN 'us_10y' WHEN 'LARGE' THEN 'aud_usd' WHEN 'PROMO' THEN 'bonds' ELSE lower(asset) END AS name,
        dt, close AS value FROM types)"""
ASSETS = """assets AS (
      SELECT p_brand AS asset, row_number() OVER (ORDER BY p_brand) AS ord,
        ['AU', 'US', 'EU', 'ASIA'][k % 4 + 1] AS region,
        CASE k % 5 WHEN 0 THEN 'Bond' WHEN 1 THEN 'Commodity' ELSE 'Equity' END AS kind, type, name, n_parts
      FROM (SELECT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS k, min(p_name) AS name,
        min(p_type) AS type, count(*) AS n_parts FROM part GROUP BY p_brand))"""


def last(n: int, key: str = "asset") -> str:
    """The frame of a row and the ``n`` - 1 before it."""
    return f"(PARTITION BY {key} ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
