"""Inputs that the registered queries derive from the given tables, in SQL that Spark and DuckDB both read.

Tables are written as {name}, braces of JSON are doubled. ``frame`` gives the DataFrame, ``cte`` the text for an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
AS_OF = "2024-01-30 12:00:00"

_RUN = "CAST(floor(event_id / 20) AS BIGINT)"

SQL = {
    # orders as a raw table: P is cancelled
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,4)) * CAST(1.0025 AS DECIMAL(18,4)) AS order_total,
               o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE o_orderstatus END AS status
        FROM {orders}""",
    "staged": """
        SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus, o_orderdate AS created_at,
               o_orderdate + (o_orderkey % 7 - 1) * INTERVAL '1' DAY AS updated_at
        FROM {orders}""",
    "contacts": """
        SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE lower(c_name) END AS email,
               '1-' || substr('00' || CAST(c_custkey % 1000 AS VARCHAR(20)), -3) || '-555-' || CASE WHEN c_custkey % 7 = 0 THEN '12' ELSE '1234' END AS phone,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation_key
        FROM {customer}""",
    "priced": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,4)) AS amount
        FROM {lineitem}""",
    "run_events": f"""
        SELECT event_id, {_RUN} AS run_id, 'p' || CAST({_RUN} % 3 AS VARCHAR(20)) AS pipeline,
               CASE WHEN event_id % 10 = 9 THEN 'check:a' || CAST(event_id % 4 AS VARCHAR(20)) || ':unique:grain' ELSE 'a' || CAST(event_id % 10 AS VARCHAR(20)) END AS asset,
               CASE WHEN event_id % 20 = 0 THEN 'run_started' WHEN event_id % 20 = 19 THEN 'run_completed'
                    WHEN event_id % 20 = 9 THEN CASE event_type WHEN 'error' THEN 'check_failed' ELSE 'check_passed' END
                    WHEN event_type = 'error' THEN 'asset_failed' WHEN event_type = 'view' THEN 'asset_skipped' ELSE 'asset_succeeded' END AS event_type,
               CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'warning' WHEN user_id % 50 = 0 THEN 'critical' ELSE 'info' END AS severity,
               ts AS "timestamp", CAST(round(value * 100) AS BIGINT) AS duration_ms,
               CASE WHEN event_id % 20 = 19 THEN '{{{{"status":"' || CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'completed_with_failures' END || '","succeeded":' || CAST(event_id % 7 AS VARCHAR(20))
                         || ',"failed":' || CAST(event_id % 3 AS VARCHAR(20)) || ',"skipped":' || CAST(event_id % 2 AS VARCHAR(20)) || ',"total_nodes":' || CAST(event_id % 7 + event_id % 3 + event_id % 2 AS VARCHAR(20)) || ',"duration_seconds":' || CAST(event_id % 50 AS VARCHAR(20)) || '}}}}'
                    WHEN event_type = 'error' THEN '{{{{"error_message":"' || CASE user_id % 20 WHEN 0 THEN 'rateLimitExceeded: slow down' WHEN 1 THEN 'HTTP 429' WHEN 2 THEN 'Too Many Requests'
                         WHEN 3 THEN 'Quota exceeded for project' WHEN 4 THEN 'RESOURCE_EXHAUSTED' WHEN 5 THEN 'connection reset by peer' WHEN 6 THEN 'dial tcp: lookup' WHEN 7 THEN 'UNAVAILABLE' WHEN 8 THEN 'unexpected EOF'
                         WHEN 9 THEN 'DNS failure' WHEN 10 THEN 'context deadline exceeded' WHEN 11 THEN 'HTTP 408' WHEN 12 THEN 'HTTP 504' WHEN 13 THEN 'Bad Gateway' WHEN 14 THEN 'Service Unavailable' WHEN 15 THEN 'internalError'
                         WHEN 16 THEN 'typeof thereof' WHEN 17 THEN 'Internal error' WHEN 18 THEN '' ELSE 'column not found' END || '"}}}}'
                    WHEN event_type = 'signup' THEN '{{{{}}}}'
                    ELSE '{{{{"metadata":{{{{"total_bytes_processed":"' || CASE WHEN user_id % 9 = 0 THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR(20)) END || '","estimated_cost_usd":"' || CAST(CAST(event_id % 97 AS DECIMAL(18,6)) AS VARCHAR(30))
                         || '","cache_hit":"' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '"}}}}}}}}' END AS details
        FROM {{events}}""",
    "specs": """
        SELECT 'hourly' AS asset, min(date_trunc('day', ts)) AS "start", min(date_trunc('day', ts)) + INTERVAL '49' HOUR AS "end", 'hour' AS unit, 2 AS lookback, 10 AS batch_size, '6h' AS "window" FROM {events}
        UNION ALL SELECT 'daily', min(date_trunc('day', ts)), max(ts), 'day', 1, 0, '2d' FROM {events}
        UNION ALL SELECT 'weekly', min(date_trunc('day', ts)), max(ts), 'week', 0, 2, '9d' FROM {events}
        UNION ALL SELECT 'empty', max(ts), min(ts), 'day', 3, 5, '1h' FROM {events}""",
    "state": """
        SELECT 'daily' AS asset, d AS interval_start, CASE k WHEN 0 THEN 'complete' WHEN 1 THEN 'complete' WHEN 2 THEN 'failed' ELSE 'in_progress' END AS status,
               'run' || CAST(k AS VARCHAR(20)) AS run_id, d + INTERVAL '26' HOUR AS started_at, CASE WHEN k < 2 THEN d + INTERVAL '27' HOUR END AS completed_at
        FROM (SELECT DISTINCT date_trunc('day', ts) AS d, day(ts) % 5 AS k FROM {events}) WHERE k < 4
        UNION ALL
        SELECT DISTINCT 'hourly', date_trunc('hour', ts), 'complete', 'h', date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL '5' MINUTE FROM {events} WHERE hour(ts) % 3 = 0""",
    "state_log": """
        SELECT 'a' || CAST(user_id % 40 AS VARCHAR(20)) AS asset, date_trunc('day', ts) AS interval_start,
               CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'in_progress' WHEN 'error' THEN 'failed' ELSE 'complete' END AS status,
               'r' || CAST(event_id % 13 AS VARCHAR(20)) AS run_id, ts AS "at", event_id AS seq
        FROM {events}""",
    "history": """
        SELECT 'p' || CAST(user_id % 2 AS VARCHAR(20)) AS pipeline, 'events' AS table_name, 'value' AS column_name, 'sum' AS metric_name, 'event_type=' || event_type AS segment_value,
               CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, date_trunc('hour', ts) AS captured_at
        FROM {events} GROUP BY user_id % 2, event_type, date_trunc('hour', ts)""",
    "activations": """
        SELECT user_id % 200 AS asset, event_type || chr(10) || CAST(user_id % 3 AS VARCHAR(20)) AS source, ts AS activated_at, event_id AS seq, CAST(floor(event_id / 20) AS BIGINT) AS run_id
        FROM {events}""",
    "edges": """
        SELECT DISTINCT parent, child FROM (
            SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS parent, p_partkey AS child FROM {part} WHERE p_partkey >= 2
            UNION ALL SELECT CAST(floor(p_partkey / 3) AS BIGINT), p_partkey FROM {part} WHERE p_partkey >= 2) e""",
    "nodes": """
        SELECT 'n' || CAST(p_partkey AS VARCHAR(20)) AS asset,
               CASE p_partkey % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'staging' WHEN 2 THEN 'intermediate' WHEN 3 THEN 'entity' ELSE 'report' END AS layer, p_partkey AS k
        FROM {part}""",
    "results": """
        SELECT 'check:a' || CAST(c_custkey % 4 AS VARCHAR(20)) || CASE WHEN c_custkey % 13 = 0 THEN '_' ELSE ':rule:' END || CAST(c_custkey AS VARCHAR(20)) AS node,
               CASE c_custkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END AS status,
               CASE WHEN c_custkey % 2 = 0 THEN 'rows violate' ELSE '' END AS message,
               CASE c_custkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity,
               c_custkey % 5 = 0 AS blocking
        FROM {customer} UNION ALL SELECT 'a1', 'failed', 'not a check', 'error', false FROM {region}""",
}

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame."""
    text = SQL[name].replace(' "start"', " `start`").replace(' "end"', " `end`").replace(' "window"', " `window`").replace(' "timestamp"', " `timestamp`").replace(' "at"', " `at`")
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    out = spark.sql(text, **used)
    # date_trunc gives zoned timestamps; the tables, and so the fixtures, have none
    return out.withColumns({c: out[c].cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})


def cte(*names: str) -> str:
    """``WITH`` clause of fixtures for DuckDB."""
    out = []
    for n in names:
        text = SQL[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        out.append(f"{n} AS ({text.replace('{{', '{').replace('}}', '}')})")
    return "WITH RECURSIVE " + ",\n".join(out)
