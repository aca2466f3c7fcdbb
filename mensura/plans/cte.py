"""ANSI SQL (DuckDB dialect) views mirroring the Spark panel builders.

Used only by ``oracle_sql()``: the driver runs these next to the Spark
queries on the same parquet tables. ``with_views(body, *names)`` prepends the
named views and everything they depend on, in dependency order.
"""

from __future__ import annotations

_WIN = "PARTITION BY series_id ORDER BY period"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("rev_panel", (), """
SELECT n.n_name AS series_id,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period,
       CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))
                      * (1 - CAST(l.l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS target,
       CAST(COUNT(DISTINCT o.o_orderkey) AS BIGINT) AS n_orders,
       CAST(COUNT(DISTINCT o.o_custkey) AS BIGINT) AS n_customers,
       CAST(SUM(l.l_quantity) AS DOUBLE) AS quantity,
       CAST(SUM(CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*) AS avg_disc,
       CAST(SUM(CAST(l.l_tax AS DECIMAL(4,2))) AS DOUBLE) / COUNT(*) AS avg_tax
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2""")

view("part_panel", (), """
SELECT p.p_brand AS series_id,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS period,
       CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))
                      * (1 - CAST(l.l_discount AS DECIMAL(4,2)))), 2) AS DOUBLE) AS target
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY 1, 2""")

view("rp_spine", ("rev_panel",), """
SELECT series_id,
       CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                   INTERVAL 1 MONTH)) AS DATE) AS period
FROM (SELECT series_id, min(period) AS lo, max(period) AS hi FROM rev_panel GROUP BY 1)""")

_COVS = ["target", "n_orders", "n_customers", "quantity", "avg_disc", "avg_tax"]
view("rev_panel_dense", ("rp_spine",), "SELECT s.series_id, s.period, "
     + ", ".join(f"last_value(r.{c} IGNORE NULLS) OVER w AS {c}" for c in _COVS)
     + """, r.series_id IS NULL AS imputed
FROM rp_spine s LEFT JOIN rev_panel r ON s.series_id = r.series_id AND s.period = r.period
WINDOW w AS (PARTITION BY s.series_id ORDER BY s.period
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

view("targets", ("rev_panel_dense",), f"""
SELECT *, log_y - log_lag1 AS mom_logdiff, log_y - log_lag12 AS yoy_logdiff,
       regr_intercept(log_y, t) OVER before + regr_slope(log_y, t) OVER before * t AS trend_full,
       log_y - (regr_intercept(log_y, t) OVER before + regr_slope(log_y, t) OVER before * t) AS trend_dev
FROM (SELECT *, lag(log_y, 1) OVER ({_WIN}) AS log_lag1,
             lag(log_y, 12) OVER ({_WIN}) AS log_lag12
      FROM (SELECT *, CAST(row_number() OVER ({_WIN}) - 1 AS INTEGER) AS t,
                   CASE WHEN target > 0 THEN ln(target) END AS log_y
            FROM rev_panel_dense))
WINDOW before AS ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

view("zero_fc", ("targets",), f"""
SELECT series_id, period, k.target_kind, target AS actual,
       exp(CASE k.target_kind WHEN 'mom_logdiff' THEN log_lag1
                              WHEN 'yoy_logdiff' THEN log_lag12
                              ELSE trend_next END) AS predicted
FROM (SELECT *, regr_intercept(log_y, t) OVER wt + regr_slope(log_y, t) OVER wt * t AS trend_next,
             row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS rn
      FROM targets
      WINDOW wt AS ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
CROSS JOIN (VALUES ('mom_logdiff'), ('yoy_logdiff'), ('trend_dev')) AS k(target_kind)
WHERE rn <= 12""")

view("event_panel", (), """
SELECT event_type AS series_id, CAST(ts AS DATE) AS period,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS target,
       CAST(COUNT(*) AS BIGINT) AS n_events
FROM events GROUP BY 1, 2""")

view("posts", (), """
SELECT d.doc_id AS post_id, d.text AS title,
       CAST(epoch_us(e.ts) // 1000000 AS BIGINT) AS created_utc
FROM documents d JOIN events e ON d.doc_id = e.event_id""")

view("objs", (), """
SELECT c.c_custkey AS obj_id,
       CASE WHEN c.c_acctbal >= 0 THEN 'node' ELSE 'way' END AS osm_type,
       c.c_acctbal AS lon, CAST(c.c_nationkey AS DOUBLE) AS lat,
       c.c_mktsegment AS shop,
       CAST(date_trunc('month', min(o.o_orderdate)) AS DATE) AS first_seen,
       CAST(date_trunc('month', max(o.o_orderdate)) AS DATE) AS last_seen
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_acctbal, c.c_nationkey, c.c_mktsegment""")


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
