"""DuckDB SQL for the logical tables of ``listwatch.sources.tables``.

Each constant is a CTE body; ``with_views`` assembles the ones a query
needs. They must stay equal in meaning to the Spark readers.
"""

from __future__ import annotations

VIEWS = {
    "sightings": """
        SELECT CAST(l_partkey AS VARCHAR) AS url,
               CAST(l_shipdate AS TIMESTAMP) AS seen_at,
               '₪ ' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS price_raw,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
               CASE l_returnflag WHEN 'A' THEN 'agency' WHEN 'R' THEN 'private' END AS seller_type,
               l_orderkey AS o_key, l_linenumber AS line_no, l_extendedprice AS x_price, l_suppkey AS s_key
        FROM lineitem""",
    "listings": """
        SELECT CAST(p_partkey AS VARCHAR) AS url, p_brand AS brand, p_type AS model, p_name AS title,
               p_retailprice AS list_price, f.first_seen_at, f.last_seen_at, f.price_raw, f.price, f.seller_type
        FROM part LEFT JOIN (
            SELECT url, first_seen_at, last_seen_at, price_raw, price, seller_type FROM (
                SELECT url, seen_at, price_raw, price, seller_type,
                       min(seen_at) OVER (PARTITION BY url) AS first_seen_at,
                       max(seen_at) OVER (PARTITION BY url) AS last_seen_at,
                       row_number() OVER (PARTITION BY url ORDER BY seen_at DESC, o_key DESC, line_no DESC,
                                          x_price DESC, s_key DESC) AS rk
                FROM sightings) WHERE rk = 1) f
        ON f.url = CAST(p_partkey AS VARCHAR)""",
    "subscriptions": """
        SELECT c_custkey AS user_id, 'brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS brand,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'promo' WHEN 2 THEN 'ring' ELSE 'small' END AS model
        FROM customer
        UNION ALL
        SELECT c_custkey AS user_id, 'BRAND#' || CAST(c_nationkey % 25 + 1 AS VARCHAR) AS brand,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '' WHEN 'BUILDING' THEN 'gear'
                    WHEN 'FURNITURE' THEN 'large' WHEN 'HOUSEHOLD' THEN 'hot' WHEN 'MACHINERY' THEN 'ring'
                    ELSE '' END AS model
        FROM customer""",
    "seller_filters": """
        SELECT c_custkey AS user_id, 'private' AS seller_type FROM customer
            WHERE c_mktsegment IN ('AUTOMOBILE', 'FURNITURE')
        UNION ALL
        SELECT c_custkey AS user_id, 'agency' AS seller_type FROM customer
            WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')""",
    "sub_matches": """
        SELECT s.user_id, s.brand AS sub_brand, s.model AS sub_model, l.*
        FROM subscriptions s JOIN listings l
          ON lower(trim(l.brand)) = lower(trim(s.brand))
         AND (lower(trim(s.model)) = ''
              OR contains(lower(trim(l.model)), lower(trim(s.model)))
              OR contains(lower(trim(l.title)), lower(trim(s.model))))""",
    "user_matches": """
        SELECT * EXCLUDE (sub_brand, sub_model, rk) FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY sub_brand, sub_model) AS rk
            FROM sub_matches) WHERE rk = 1""",
    "job_runs": """
        SELECT event_id, user_id, event_type AS brand_key, CAST(ts AS TIMESTAMP) AS started_at FROM events""",
}

# dependencies between the views, so callers name only what they use
DEPS = {
    "listings": ["sightings"],
    "sub_matches": ["subscriptions", "listings"],
    "user_matches": ["sub_matches"],
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views>, <extra ctes> <body>``."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _order(names)]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def user_matches_sql(listings_view: str) -> str:
    """One row per (user_id, url) of ``subscriptions`` matched to a listings
    view (same rule as VIEWS['sub_matches'])."""
    return f"""
        SELECT * EXCLUDE (rk) FROM (
            SELECT s.user_id, l.*, row_number() OVER (PARTITION BY s.user_id, l.url ORDER BY s.brand, s.model) AS rk
            FROM subscriptions s JOIN {listings_view} l
              ON lower(trim(l.brand)) = lower(trim(s.brand))
             AND (lower(trim(s.model)) = ''
                  OR contains(lower(trim(l.model)), lower(trim(s.model)))
                  OR contains(lower(trim(l.title)), lower(trim(s.model))))) WHERE rk = 1"""
