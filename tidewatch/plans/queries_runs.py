"""Registered queries: monitoring, run log, model history, lineage, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import graphs, history, intervals, lineage, monitor, runlog, sketches
from tidewatch.plans.fixtures import AS_OF, frame, table
from tidewatch.plans.queries import _catalog, _path, register
from tidewatch.sources import batch, files
from tidewatch.sources.slices import SliceTable
from tidewatch.sources.statelog import StateLog
from tidewatch.streaming import flows, freshness

# ---- monitoring ---------------------------------------------------------------------------------------------

_KEYS = "'{t}' AS table_name, {c} AS column_name, '{m}' AS metric_name, '' AS segment_value"


def _metric(t: str, c: str, m: str, value: str, source: str) -> str:
    return f"SELECT {_KEYS.format(t=t, c=chr(39) + c + chr(39), m=m)}, {value} AS value FROM {source}"


register("metric_row_count", lambda s, d: monitor.metric_row_count(table(s, d, "lineitem"), "lineitem"), _metric("lineitem", "", "row_count", "count(*)::DOUBLE", "lineitem"))
register("metric_null_rate", lambda s, d: monitor.metric_null_rate(frame(s, d, "staged"), "staged", ["priority", "created_at"]),
         _metric("staged", "priority", "null_rate", "count(*) FILTER (WHERE priority IS NULL) / count(*)", "staged") + " UNION ALL " + _metric("staged", "created_at", "null_rate", "count(*) FILTER (WHERE created_at IS NULL) / count(*)", "staged"), "staged")
_WANTED = [("l_quantity", "sum"), ("l_quantity", "avg"), ("l_quantity", "min"), ("l_quantity", "max"), ("l_quantity", "median"), ("l_shipdate", "count"), ("l_tax", "spread")]
register("metric_aggregate", lambda s, d: monitor.metric_aggregate(table(s, d, "lineitem"), "lineitem", _WANTED),
         " UNION ALL ".join(_metric("lineitem", c, m, {"median": f"quantile_disc({c}, 0.5)", "spread": f"count({c})::DOUBLE"}.get(m, f"{m}({c})::DOUBLE"), "lineitem") for c, m in _WANTED))
register("metric_rate", lambda s, d: monitor.metric_rate(table(s, d, "orders").where("o_orderstatus = 'F'"), table(s, d, "orders"), "orders", "finished"),
         _metric("orders", "finished", "rate", "count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)", "orders"))
_SEGMENT = "SELECT 'staged' AS table_name, 'priority' AS column_name, 'count' AS metric_name, 'priority=' || coalesce(priority, '<nil>') AS segment_value, count(*)::DOUBLE AS value FROM staged GROUP BY priority"
register("metric_segment", lambda s, d: monitor.metric_segment(frame(s, d, "staged"), "staged", "priority"), _SEGMENT, "staged")
register("metric_snapshot", lambda s, d: monitor.metric_snapshot([monitor.metric_row_count(table(s, d, "orders"), "orders"), monitor.metric_segment(frame(s, d, "staged"), "staged", "priority")], "p1", AS_OF),
         f"SELECT 'p1' AS pipeline, *, TIMESTAMP '{AS_OF}' AS captured_at FROM ({_metric('orders', '', 'row_count', 'count(*)::DOUBLE', 'orders')} UNION ALL {_SEGMENT})", "staged")
_WINDOWS = ", w(\"window\", a, b) AS (VALUES ('day', TIMESTAMP '2024-01-29', TIMESTAMP '2024-01-30'), ('week', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-23'), ('month', TIMESTAMP '2023-12-01', TIMESTAMP '2024-01-01'), ('year', TIMESTAMP '2023-01-30', TIMESTAMP '2023-01-31'))"
_PRIOR = "SELECT pipeline, table_name, column_name, metric_name, segment_value, \"window\", avg(value) AS prior_value, count(*) AS n FROM history JOIN w ON captured_at >= a AND captured_at < b GROUP BY ALL"
register("prior_average", lambda s, d: monitor.prior_average(frame(s, d, "history"), AS_OF).withColumn("prior_value", F.round("prior_value", 6)),
         f"{_WINDOWS} SELECT * REPLACE (round(prior_value, 6) AS prior_value) FROM ({_PRIOR})", "history")


def _current(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "history").where("captured_at = (timestamp_ntz'2024-01-29 12:00:00')").drop("captured_at")


def _config(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("events", "value", "sum", 0.05, 0.5)], "table_name string, column_name string, metric_name string, warning double, error double")


_FLAGS = f"""{_WINDOWS}, prior AS ({_PRIOR}),
flags AS (SELECT h.pipeline, h.table_name, h.column_name, h.metric_name, h.segment_value, p."window", h.value AS current_value, p.prior_value, (h.value - p.prior_value) / p.prior_value AS pct_change FROM history h JOIN prior p ON h.segment_value = p.segment_value AND h.pipeline = p.pipeline WHERE h.captured_at = TIMESTAMP '2024-01-29 12:00:00' AND p.n >= 2 AND p.prior_value <> 0),
graded AS (SELECT * REPLACE (round(prior_value, 6) AS prior_value, round(pct_change, 6) AS pct_change), CASE WHEN abs(pct_change) >= 0.5 THEN 'error' WHEN abs(pct_change) >= 0.05 THEN 'warning' END AS severity FROM flags)"""


def _flags(s: SparkSession, d: str) -> DataFrame:
    return monitor.drift_flags(_current(s, d), frame(s, d, "history"), AS_OF, _config(s)).withColumns({c: F.round(c, 6) for c in ("prior_value", "pct_change")})


register("drift_flags", _flags, f"{_FLAGS} SELECT * FROM graded WHERE severity IS NOT NULL", "history")
register("flags_as_errors", lambda s, d: monitor.flags_as_errors(_flags(s, d), AS_OF).withColumns({c: F.get_json_object("details_json", f"$.{c}").cast("double") for c in ("current_value", "prior_value", "pct_change")}).withColumn("w", F.get_json_object("details_json", "$.window")).drop("details_json"),
         f"{_FLAGS} SELECT pipeline, table_name AS asset, 'distribution_' || table_name || '_' || column_name || '_' || metric_name AS check_name, severity, format('{{}} {{}}.{{}} {{}} changed {{:.1f}}% over {{}}', severity, table_name, column_name, metric_name, pct_change * 100, \"window\") AS message, TIMESTAMP '{AS_OF}' AS run_at, current_value, prior_value, pct_change, \"window\" AS w FROM graded WHERE severity IS NOT NULL", "history")
_PROFILE = [("c_custkey", "bigint"), ("email", "string"), ("phone", "string"), ("nation_key", "int")]
register("table_profile", lambda s, d: monitor.table_profile(frame(s, d, "contacts"), "contacts"),
         "".join([" UNION ALL " * (i > 0) + f"SELECT 'contacts' AS table_name, '{c}' AS column_name, '{t}' AS data_type, {i + 1} AS ordinal, count(*) AS row_count, count(*) - count({c}) AS null_count FROM contacts" for i, (c, t) in enumerate(_PROFILE)]), "contacts")
register("schema_catalog", lambda s, d: _catalog(s, d).join(table(s, d, "region").agg(F.count(F.lit(1)).alias("regions")), F.lit(True)).select("run_seq", "table_name", "column_name", "ordinal", "regions"),
         "SELECT 1 AS run_seq, table_name, column_name, column_index AS ordinal, (SELECT count(*) FROM region) AS regions FROM duckdb_columns() WHERE table_name IN ('orders', 'customer', 'events')")



def sketch_query(s: SparkSession, d: str) -> DataFrame:
    """Medians by segment from sketches that were stored by day in two runs and merged: how far their ranks are from the middle, in steps of the bound."""
    rows = table(s, d, "events").withColumn("slice", F.date_format("ts", "yyyy-MM-dd"))
    store, slices = SliceTable(s, _path(s, "sketches")), rows.select("slice").distinct()
    for run, part in (("one", "slice < '2024-01-15'"), ("two", "slice >= '2024-01-10'")):
        sketches.update_sketches(store, rows, slices.where(part), ["value"], run, AS_OF, "event_type")
    middle = sketches.quantile_metrics(store.read(), "events", {"median": 0.5}, True)
    exact = table(s, d, "events").withColumn("segment_value", F.concat(F.lit("event_type="), "event_type")).join(middle.select("segment_value", F.col("value").alias("m")), "segment_value")
    off = F.greatest(F.avg((F.col("value") < F.col("m")).cast("double")) - 0.5, 0.5 - F.avg((F.col("value") <= F.col("m")).cast("double")), F.lit(0.0))
    return exact.groupBy("segment_value").agg(F.count("value").alias("n"), (off <= 1.7 / sketches.K).alias("within_bound"))


register("quantile_sketches", sketch_query, "SELECT 'event_type=' || event_type AS segment_value, count(value) AS n, true AS within_bound FROM events GROUP BY event_type")

# ---- run log ------------------------------------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "run_events")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return runlog.run_summary(_events(s, d))


_RUNS = """, runs AS (SELECT run_id, any_value(pipeline) AS pipeline, min("timestamp") FILTER (WHERE event_type = 'run_started') AS started_at, max("timestamp") FILTER (WHERE event_type = 'run_completed') AS completed_at,
coalesce(max(json_extract_string(details, '$.status')) FILTER (WHERE event_type = 'run_completed'), 'running') AS status, max(json_extract_string(details, '$.duration_seconds')::DOUBLE) FILTER (WHERE event_type = 'run_completed') AS duration_s,
max(json_extract_string(details, '$.succeeded')::INTEGER) FILTER (WHERE event_type = 'run_completed') AS succeeded, max(json_extract_string(details, '$.failed')::INTEGER) FILTER (WHERE event_type = 'run_completed') AS failed,
max(json_extract_string(details, '$.skipped')::INTEGER) FILTER (WHERE event_type = 'run_completed') AS skipped, max(json_extract_string(details, '$.total_nodes')::INTEGER) FILTER (WHERE event_type = 'run_completed') AS total_nodes
FROM run_events WHERE event_type IN ('run_started', 'run_completed') GROUP BY run_id)
"""
_OK, _BAD = "event_type = 'asset_succeeded'", "event_type = 'asset_failed'"
register("event_filter", lambda s, d: runlog.event_filter(_events(s, d), pipeline="p1", event_types="asset_failed,asset_skipped", min_severity="error", since="2024-01-03 00:00:00", until="2024-01-25 00:00:00").select("event_id", "run_id", "severity"),
         "SELECT event_id, run_id, severity FROM run_events WHERE pipeline = 'p1' AND event_type IN ('asset_failed', 'asset_skipped') AND severity IN ('error', 'critical') AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'", "run_events")
register("run_summary", _runs, _RUNS + "SELECT * FROM runs", "run_events")
register("run_outcomes", lambda s, d: runlog.run_summary(_events(s, d).withColumns({"event_type": F.when((F.col("event_type") == "run_completed") & (F.col("run_id") % 7 == 3), "run_failed").otherwise(F.col("event_type")), "details": F.when(F.col("run_id") % 7 == 4, "{}").otherwise(F.col("details"))})),
         _RUNS + """, ends AS (SELECT run_id, duration_ms FROM run_events WHERE event_type = 'run_completed')
         SELECT r.run_id, pipeline, started_at, completed_at, CASE WHEN status = 'running' THEN status WHEN r.run_id % 7 = 3 THEN 'failed' WHEN r.run_id % 7 = 4 THEN '' ELSE status END AS status,
         CASE WHEN r.run_id % 7 = 3 THEN duration_ms / 1000 WHEN r.run_id % 7 = 4 AND status <> 'running' THEN 0 ELSE duration_s END AS duration_s,
         CASE WHEN r.run_id % 7 IN (3, 4) AND status <> 'running' THEN 0 ELSE succeeded END AS succeeded, CASE WHEN r.run_id % 7 IN (3, 4) AND status <> 'running' THEN 0 ELSE failed END AS failed,
         CASE WHEN r.run_id % 7 IN (3, 4) AND status <> 'running' THEN 0 ELSE skipped END AS skipped, CASE WHEN r.run_id % 7 IN (3, 4) AND status <> 'running' THEN 0 ELSE total_nodes END AS total_nodes
         FROM runs r LEFT JOIN ends e ON e.run_id = r.run_id""", "run_events")
register("list_runs", lambda s, d: runlog.list_runs(_events(s, d), 15).select("run_id", "started_at"), _RUNS + "SELECT run_id, started_at FROM runs ORDER BY started_at DESC, run_id LIMIT 15", "run_events")
register("run_history", lambda s, d: runlog.run_history(_runs(s, d), "p1", "2024-01-10 00:00:00", ["completed"], 10).select("run_id", "started_at", "status"),
         _RUNS + "SELECT run_id, started_at, status FROM runs WHERE pipeline = 'p1' AND started_at >= TIMESTAMP '2024-01-10' AND status = 'completed' ORDER BY started_at DESC, run_id LIMIT 10", "run_events")
register("active_runs", lambda s, d: runlog.active_runs(runlog.run_summary(_events(s, d).where("event_id % 3 <> 0 OR event_type <> 'run_completed'"))).select("run_id", "status"),
         _RUNS + "SELECT run_id, 'running' AS status FROM runs WHERE (run_id * 20 + 19) % 3 = 0 ORDER BY started_at DESC, run_id LIMIT 50", "run_events")
register("failed_nodes", lambda s, d: runlog.failed_nodes(_events(s, d)), f"SELECT DISTINCT run_id, asset FROM run_events WHERE {_BAD}", "run_events")
register("node_results", lambda s, d: runlog.node_results(_events(s, d)).select("event_id", "run_id", "asset", "status", "duration_ms", "error", F.col("metadata")["cache_hit"].alias("cache_hit")),
         "SELECT event_id, run_id, asset, replace(CASE WHEN event_type = 'asset_succeeded' THEN 'success' ELSE event_type END, 'asset_', '') AS status, duration_ms, json_extract_string(details, '$.error_message') AS error, json_extract_string(details, '$.metadata.cache_hit') AS cache_hit FROM run_events WHERE event_type LIKE 'asset%'", "run_events")
register("check_results", lambda s, d: runlog.check_results(_events(s, d), "a1").select("event_id", "asset", "status"),
         "SELECT event_id, asset, event_type[7:] AS status FROM run_events WHERE event_type IN ('check_passed', 'check_failed') AND asset LIKE 'check:a1:%'", "run_events")
register("last_success", lambda s, d: runlog.last_success(_events(s, d)), f"SELECT asset, max(\"timestamp\") AS last_success FROM run_events WHERE {_OK} GROUP BY asset", "run_events")
register("run_cost", lambda s, d: runlog.run_cost(_events(s, d)),
         f"""SELECT run_id, coalesce(sum(b), 0)::BIGINT AS total_bytes, coalesce(sum(c) FILTER (WHERE b IS NOT NULL), 0)::DOUBLE AS total_cost, count(b) AS query_nodes, count(*) FILTER (WHERE b IS NOT NULL AND hit) AS cached_nodes, coalesce(count(*) FILTER (WHERE b IS NOT NULL AND hit) / nullif(count(b), 0), 0) AS hit_rate
         FROM (SELECT run_id, try_cast(json_extract_string(details, '$.metadata.total_bytes_processed') AS BIGINT) AS b, json_extract_string(details, '$.metadata.estimated_cost_usd')::DECIMAL(18,6) AS c, json_extract_string(details, '$.metadata.cache_hit') = 'true' AS hit FROM run_events WHERE {_OK}) GROUP BY run_id""", "run_events")
register("node_stats", lambda s, d: runlog.node_stats(_events(s, d), "2024-01-05 00:00:00"),
         f"SELECT pipeline, asset, count(*) AS runs, count(*) FILTER (WHERE {_OK}) AS successes, count(*) FILTER (WHERE {_BAD}) AS failures, count(*) FILTER (WHERE {_OK}) / count(*) AS success_rate, (sum(duration_ms) // count(*))::BIGINT AS avg_duration_ms FROM run_events WHERE ({_OK} OR {_BAD}) AND \"timestamp\" >= TIMESTAMP '2024-01-05' GROUP BY pipeline, asset", "run_events")
register("top_errors", lambda s, d: runlog.top_errors(_events(s, d), 2),
         f"SELECT asset, error, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY n DESC, error) AS rank FROM (SELECT asset, coalesce(json_extract_string(details, '$.error_message'), '') AS error, count(*) AS n FROM run_events WHERE {_BAD} GROUP BY ALL)) WHERE rank <= 2", "run_events")
register("failure_report", lambda s, d: runlog.failure_report(_runs(s, d), _events(s, d)),
         _RUNS + f"SELECT r.run_id, r.pipeline, r.status, e.event_id, e.asset, json_extract_string(e.details, '$.error_message') AS error FROM runs r LEFT JOIN (SELECT * FROM run_events WHERE {_BAD}) e ON e.run_id = r.run_id WHERE r.status = 'completed_with_failures'", "run_events")
register("run_rollup", lambda s, d: runlog.run_rollup(_events(s, d)),
         f"""SELECT run_id, count(*) FILTER (WHERE {_OK}) AS succeeded, count(*) FILTER (WHERE {_BAD}) AS failed, count(*) FILTER (WHERE event_type = 'asset_skipped') AS skipped,
         CASE WHEN count(*) FILTER (WHERE {_BAD}) > 0 THEN 'completed_with_failures' ELSE 'success' END AS status,
         coalesce(sum(json_extract_string(details, '$.metadata.estimated_cost_usd')::DECIMAL(18,6)) FILTER (WHERE event_type LIKE 'asset%'), 0)::DOUBLE AS total_cost,
         format('{{}}: {{}} succeeded, {{}} failed, {{}} skipped ({{:.0f}}s)', min(pipeline), count(*) FILTER (WHERE {_OK}), count(*) FILTER (WHERE {_BAD}), count(*) FILTER (WHERE event_type = 'asset_skipped'), coalesce(max(json_extract_string(details, '$.duration_seconds')::DOUBLE), 0)) AS summary,
         coalesce(string_agg(asset, ',' ORDER BY asset, event_id) FILTER (WHERE {_BAD}), '') AS failed_assets,
         coalesce(string_agg(asset || ': ' || json_extract_string(details, '$.error_message')[:200], '; ' ORDER BY asset, event_id) FILTER (WHERE {_BAD} AND json_extract_string(details, '$.error_message') <> ''), '') AS errors
         FROM run_events WHERE event_type LIKE 'asset%' OR event_type = 'run_completed' GROUP BY run_id HAVING count(*) FILTER (WHERE event_type LIKE 'asset%') > 0""", "run_events")
register("error_breakdown", lambda s, d: runlog.error_breakdown(_events(s, d)),
         f"""SELECT c AS error_class, count(*) AS n, c <> 'none' AS retryable FROM (SELECT CASE WHEN k < 3 THEN 'rate_limit' WHEN k < 5 THEN 'quota' WHEN k < 10 THEN 'network' WHEN k < 13 THEN 'timeout' WHEN k < 16 THEN 'server' ELSE 'none' END AS c
         FROM (SELECT e.user_id % 20 AS k FROM run_events r JOIN events e ON e.event_id = r.event_id WHERE r.{_BAD})) GROUP BY c""", "run_events")
register("duration_histogram", lambda s, d: runlog.duration_histogram(_runs(s, d), F.col("duration_s"), 1.0, ["pipeline"]),
         _RUNS + """, b AS (SELECT 2.0 ** k AS bound, format('{:g}', (2.0 ** k)::DOUBLE) AS le FROM range(15) t(k) UNION ALL SELECT 1e300, '+Inf')
         SELECT r.pipeline, b.le, count(*) FILTER (WHERE r.duration_s <= b.bound) AS n FROM runs r, b GROUP BY r.pipeline, b.le""", "run_events")
register("run_totals", lambda s, d: runlog.run_totals(_runs(s, d)), _RUNS + "SELECT pipeline, status, count(*) AS runs, coalesce(sum(total_nodes), 0)::BIGINT AS nodes FROM runs GROUP BY ALL", "run_events")
register("retention_delete", lambda s, d: runlog.retention_delete(_events(s, d), "2024-01-15 00:00:00").select("event_id", "timestamp"), "SELECT event_id, \"timestamp\" FROM run_events WHERE \"timestamp\" >= TIMESTAMP '2024-01-15'", "run_events")


def delete_query(s: SparkSession, d: str) -> DataFrame:
    """Events in files by time: those wholly before the cutoff go, those on both sides are rewritten, and the count of what went is told."""
    path = _path(s, "events")
    _events(s, d).select("event_id", "timestamp").repartitionByRange(6, "timestamp").write.parquet(path)
    gone = files.delete_before(s, path, "timestamp", "2024-01-15 00:00:00")
    again = files.delete_before(s, path, "timestamp", "2024-01-15 00:00:00")
    return s.read.parquet(path).select("event_id", "timestamp", F.lit(gone.rows).cast("bigint").alias("deleted"), F.lit(again.rows).cast("bigint").alias("deleted_again"))


register("retention_delete_files", delete_query, "SELECT event_id, \"timestamp\", (SELECT count(*) FROM run_events WHERE \"timestamp\" < TIMESTAMP '2024-01-15') AS deleted, 0::BIGINT AS deleted_again FROM run_events WHERE \"timestamp\" >= TIMESTAMP '2024-01-15'", "run_events")


def prune_query(s: SparkSession, d: str) -> DataFrame:
    """The archive's own files say which runs may go."""
    path = _path(s, "archive")
    batch.archive_runs(_runs(s, d).where("run_id % 3 <> 0"), _events(s, d).withColumnRenamed("timestamp", "happened_at"), path)
    return runlog.prune_archived(_runs(s, d), _events(s, d), files.archived_runs(s, path), AS_OF, 10)[0].select("run_id", "status")


register("prune_archived_files", prune_query,
         _RUNS + "SELECT run_id, status FROM runs WHERE NOT coalesce(run_id % 3 <> 0 AND status <> 'running' AND completed_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY, false)", "run_events")
register("prune_archived", lambda s, d: runlog.prune_archived(_runs(s, d), _events(s, d), _runs(s, d).where("run_id % 2 = 0"), AS_OF, 10)[1].select("event_id", "run_id"),
         _RUNS + "SELECT event_id, run_id FROM run_events WHERE run_id NOT IN (SELECT run_id FROM runs WHERE run_id % 2 = 0 AND status <> 'running' AND completed_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY)", "run_events")
register("prune_intervals", lambda s, d: runlog.prune_intervals(intervals.interval_state_upsert(frame(s, d, "state_log")), AS_OF, 10).select("asset", "interval_start", "status"),
         """, f AS (SELECT asset, interval_start, min(seq) AS first FROM state_log WHERE status = 'in_progress' GROUP BY ALL),
         n AS (SELECT l.asset, l.interval_start, arg_max(l.status, l.seq) AS status, arg_max(l."at", l.seq) AS stamp FROM state_log l JOIN f ON f.asset = l.asset AND f.interval_start = l.interval_start AND l.seq >= f.first GROUP BY ALL)
         SELECT asset, interval_start, status FROM n WHERE NOT (status = 'complete' AND stamp < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 DAY)""", "state_log")

# ---- model history ------------------------------------------------------------------------------------------

_VERSIONS = """, hashed AS (SELECT *, sha256(source) AS source_hash FROM activations), lagged AS (SELECT *, lag(source_hash) OVER o AS prev, lag(seq) OVER o AS prev_seq FROM hashed WINDOW o AS (PARTITION BY asset ORDER BY activated_at, seq)),
versions AS (SELECT asset, row_number() OVER o AS version, source_hash, source, activated_at, seq, lead(activated_at) OVER o AS replaced_at FROM lagged WHERE prev_seq IS NULL OR prev <> source_hash WINDOW o AS (PARTITION BY asset ORDER BY activated_at, seq))
"""
register("model_versions", lambda s, d: history.model_versions(frame(s, d, "activations")), _VERSIONS + "SELECT asset, version::INTEGER AS version, source_hash, activated_at, seq, replaced_at, CASE WHEN version = 1 THEN 'registered' ELSE 'changed' END AS change FROM versions", "activations")
register("model_current", lambda s, d: history.model_current(history.model_versions(frame(s, d, "activations")), frame(s, d, "activations")),
         _VERSIONS + "SELECT v.asset, v.version::INTEGER AS version, v.source_hash, v.activated_at, a.last_activated_at FROM versions v JOIN (SELECT asset, max(activated_at) AS last_activated_at FROM activations GROUP BY asset) a ON a.asset = v.asset WHERE v.replaced_at IS NULL", "activations")


def _model_sources(s: SparkSession, d: str) -> DataFrame:
    log = frame(s, d, "activations")
    return history.model_versions(log).join(log.select("asset", "seq", "source"), ["asset", "seq"]).select("asset", "version", "source")


register("model_diff", lambda s, d: history.model_diff(_model_sources(s, d)),
         _VERSIONS + """, p AS (SELECT asset, version, string_split(source, chr(10)) AS n, string_split(lag(source) OVER (PARTITION BY asset ORDER BY version), chr(10)) AS o FROM versions)
         SELECT asset, version::INTEGER AS version, i::INTEGER AS line_no, o[i] AS old_line, n[i] AS new_line FROM (SELECT *, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM p WHERE o IS NOT NULL) WHERE o[i] IS DISTINCT FROM n[i]""", "activations")

# ---- lineage ------------------------------------------------------------------------------------------------

_NODE = "'n' || CAST({} AS VARCHAR(20))"


def _assets(s: SparkSession, d: str) -> DataFrame:
    """Nodes with the parents that their edges give them."""
    up = frame(s, d, "edges").groupBy(F.col("child").alias("k")).agg(F.collect_set(F.concat(F.lit("n"), F.col("parent").cast("string"))).alias("depends_on"))
    return frame(s, d, "nodes").join(up, "k", "left")


register("lineage_edges", lambda s, d: lineage.lineage_edges(_assets(s, d)),
         f"SELECT {_NODE.format('e.parent')} AS parent, c.asset AS child, c.layer AS child_layer, p.layer AS parent_layer FROM edges e JOIN nodes c ON c.k = e.child LEFT JOIN nodes p ON p.k = e.parent", "edges nodes")
register("expand_outputs", lambda s, d: lineage.expand_outputs(frame(s, d, "edges"), table(s, d, "part").where("p_size = 3").select(F.col("p_partkey").alias("asset"), F.explode(F.array(F.col("p_partkey") * -1, F.col("p_partkey") * -1 - 1000000)).alias("output"))),
         """, o AS (SELECT p_partkey AS asset, unnest([-p_partkey, -p_partkey - 1000000]) AS output FROM part WHERE p_size = 3)
         SELECT DISTINCT coalesce(a.output, e.parent) AS parent, coalesce(b.output, e.child) AS child FROM edges e LEFT JOIN o a ON a.asset = e.parent LEFT JOIN o b ON b.asset = e.child""", "edges")


def _seed(s: SparkSession, d: str, cond: str) -> DataFrame:
    return table(s, d, "part").where(cond).select(F.col("p_partkey").alias("node"))


_LEVELS = ", walk(node, level) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 11 UNION SELECT {way} = w.node) "
register("descendants", lambda s, d: lineage.descendants(frame(s, d, "edges"), _seed(s, d, "p_size = 11")),
         _LEVELS.format(way="e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent") + "SELECT node, min(level) AS level FROM walk GROUP BY node HAVING min(level) > 0", "edges")
register("ancestors", lambda s, d: lineage.ancestors(frame(s, d, "edges"), _seed(s, d, "p_size = 11"), include_seeds=True),
         _LEVELS.format(way="e.parent, w.level + 1 FROM walk w JOIN edges e ON e.child") + "SELECT node, min(level) AS level FROM walk GROUP BY node", "edges")


def _runs_seeds(s: SparkSession, d: str) -> DataFrame:
    """Failed assets of many runs: sizes of parts are runs, every fifth part and a name that no edge knows have failed."""
    parts = table(s, d, "part").where("p_partkey % 5 = 0").select(F.col("p_size").alias("run_id"), F.lit("asset_failed").alias("event_type"), F.col("p_partkey").alias("asset"))
    return parts.unionByName(parts.select("run_id", "event_type", F.lit(-1).cast("bigint").alias("asset")).distinct())


def reachability_query(s: SparkSession, d: str) -> DataFrame:
    """Both ways from one index."""
    index, seeds = graphs.Reachability.build(frame(s, d, "edges")), _seed(s, d, "p_size = 11")
    return index.descendants(seeds).withColumn("way", F.lit("down")).unionByName(index.ancestors(seeds, include_seeds=True).withColumn("way", F.lit("up")))


register("reachability", reachability_query,
         _LEVELS.format(way="e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent") + _LEVELS.format(way="e.parent, w.level + 1 FROM up w JOIN edges e ON e.child").replace("walk(", "up(")
         + "SELECT node, min(level) AS level, 'down' AS way FROM walk GROUP BY node HAVING min(level) > 0 UNION ALL SELECT node, min(level), 'up' FROM up GROUP BY node", "edges")
register("rerun_sets", lambda s, d: graphs.Reachability.build(frame(s, d, "edges")).rerun_sets(_runs_seeds(s, d)),
         """, failed AS (SELECT p_size AS run_id, p_partkey AS node FROM part WHERE p_partkey % 5 = 0), known AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges),
         walk(run_id, node) AS (SELECT run_id, node FROM failed WHERE node IN (FROM known) UNION SELECT w.run_id, e.child FROM walk w JOIN edges e ON e.parent = w.node)
         SELECT run_id, node AS asset, CASE WHEN (run_id, node) IN (FROM failed) THEN 'failed' ELSE 'downstream' END AS kind FROM walk
         UNION ALL SELECT DISTINCT run_id, -1::BIGINT, 'missing' FROM failed UNION ALL SELECT run_id, node, 'missing' FROM failed WHERE node NOT IN (FROM known)""", "edges")


def rerun_query(s: SparkSession, d: str) -> DataFrame:
    """Failed assets of all runs as seeds: their numbers name parts; those beyond the parts are missing."""
    ev = table(s, d, "events").where("event_type = 'error'").select(F.lit(1).alias("run_id"), F.lit("asset_failed").alias("event_type"), (F.col("user_id") * 7 + 100).alias("asset"))
    return lineage.rerun_set(ev, frame(s, d, "edges"), 1)


register("rerun_set", rerun_query,
         """, failed AS (SELECT DISTINCT user_id * 7 + 100 AS node FROM events WHERE event_type = 'error'), known AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges),
         walk(node) AS (SELECT node FROM failed WHERE node IN (FROM known) UNION SELECT e.child FROM walk w JOIN edges e ON e.parent = w.node)
         SELECT node AS asset, CASE WHEN node IN (FROM failed) THEN 'failed' ELSE 'downstream' END AS kind FROM walk UNION ALL SELECT node, 'missing' FROM failed WHERE node NOT IN (FROM known)""", "edges")


def cycle_query(s: SparkSession, d: str) -> DataFrame:
    """The lineage edges with a back edge from each small node's double to it."""
    edges = frame(s, d, "edges")
    back = edges.where("child = parent * 2 AND parent BETWEEN 5 AND 9").select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return lineage.find_cycles(edges.unionByName(back))


_REACH = """, reach(source, node) AS (SELECT parent, child FROM c UNION SELECT r.source, c.child FROM reach r JOIN c ON c.parent = r.node),
         strong AS (SELECT a.source AS node, min(a.node) AS component, count(*) AS size FROM reach a JOIN reach b ON b.source = a.node AND b.node = a.source GROUP BY a.source)
"""
register("find_cycles", cycle_query,
         """, c AS (SELECT parent, child FROM edges UNION SELECT child, parent FROM edges WHERE child = parent * 2 AND parent BETWEEN 5 AND 9)""" + _REACH + """,
         down(node) AS (SELECT node FROM strong UNION SELECT c.child FROM down JOIN c ON c.parent = down.node), up(node) AS (SELECT node FROM strong UNION SELECT c.parent FROM up JOIN c ON c.child = up.node)
         SELECT node FROM down WHERE node IN (FROM up)""", "edges")


def _looped(s: SparkSession, d: str) -> DataFrame:
    """The lineage edges with back edges all over the graph, from doubles of multiples of 40 and triples of multiples of 70, and some edges from a node to itself."""
    edges = frame(s, d, "edges")
    back = edges.where("(child = parent * 2 AND parent % 40 = 0) OR (child = parent * 3 AND parent % 70 = 0)").select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return edges.unionByName(back).unionByName(edges.where("parent % 90 = 0").select("parent", F.col("parent").alias("child")))


_LOOPED = """, c AS (SELECT parent, child FROM edges UNION SELECT child, parent FROM edges WHERE (child = parent * 2 AND parent % 40 = 0) OR (child = parent * 3 AND parent % 70 = 0) UNION SELECT parent, parent FROM edges WHERE parent % 90 = 0)""" + _REACH
register("strong_components", lambda s, d: graphs.strong_components(_looped(s, d)), _LOOPED + "SELECT * FROM strong", "edges")
register("cycle_paths", lambda s, d: graphs.cycle_paths(_looped(s, d)),
         _LOOPED + """, within AS (SELECT a.component, c.parent, c.child FROM c JOIN strong a ON a.node = c.parent JOIN strong b ON b.node = c.child WHERE a.component = b.component),
         ways AS (SELECT component, child AS node, [parent, child] AS path FROM within WHERE parent = component
                  UNION ALL SELECT w.component, e.child, list_append(w.path, e.child) FROM ways w JOIN within e ON e.component = w.component AND e.parent = w.node WHERE w.node <> w.component AND (e.child = w.component OR NOT list_contains(w.path, e.child))),
         closed AS (SELECT component, path FROM ways WHERE node = component QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), path) = 1)
         SELECT component, any_value(size) AS size, any_value(path) AS path FROM strong JOIN closed USING (component) GROUP BY component""", "edges")
register("topo_levels", lambda s, d: lineage.topo_levels(frame(s, d, "edges")),
         ", walk(node, level) AS (SELECT 1::BIGINT, 0 FROM region WHERE r_regionkey = 0 UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node) SELECT node, max(level) AS level FROM (FROM walk UNION ALL SELECT DISTINCT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges)) GROUP BY node", "edges")
register("layer_violations", lambda s, d: lineage.layer_violations(frame(s, d, "edges").select(*(F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in ("parent", "child"))), frame(s, d, "nodes")),
         """, r(layer, rank) AS (VALUES ('source', 0), ('staging', 1), ('intermediate', 2), ('entity', 3), ('report', 4))
         SELECT p.asset AS parent, c.asset AS child, p.layer AS parent_layer, c.layer AS child_layer FROM edges e JOIN nodes p ON p.k = e.parent JOIN nodes c ON c.k = e.child JOIN r rp ON rp.layer = p.layer JOIN r rc ON rc.layer = c.layer WHERE rc.rank < rp.rank""", "edges nodes")
register("ref_mismatch", lambda s, d: lineage.ref_mismatch(frame(s, d, "edges").where("child % 7 <> 0").select(F.col("child").alias("asset"), F.col("parent").cast("string").alias("dependency")), frame(s, d, "edges").where("child % 5 <> 0 AND parent % 4 <> 0").select(F.col("child").alias("asset"), F.col("parent").cast("string").alias("dependency"))),
         """, d AS (SELECT child AS asset, parent::VARCHAR AS dependency FROM edges WHERE child % 7 <> 0), u AS (SELECT child AS asset, parent::VARCHAR AS dependency FROM edges WHERE child % 5 <> 0 AND parent % 4 <> 0)
         SELECT *, 'UNDECLARED' AS issue_type FROM (FROM u EXCEPT FROM d) UNION ALL SELECT *, 'UNUSED' FROM (FROM d EXCEPT FROM u) WHERE asset IN (SELECT asset FROM u)""", "edges")
register("missing_upstreams", lambda s, d: lineage.missing_upstreams(frame(s, d, "edges").select(F.concat(F.lit("n"), F.col("parent").cast("string")).alias("parent"), "child"), frame(s, d, "nodes").where("k % 6 <> 0").unionByName(frame(s, d, "nodes").where("k % 35 = 1 AND k % 6 <> 0"))),
         f"""SELECT DISTINCT {_NODE.format('parent')} AS node, 'MISSING_UPSTREAM' AS issue_type FROM edges WHERE parent % 6 = 0 UNION ALL SELECT asset, 'DUPLICATE_NODE' FROM nodes WHERE k % 35 = 1 AND k % 6 <> 0""", "edges nodes")

# ---- sources, sinks, streams --------------------------------------------------------------------------------

register("read_source", lambda s, d: batch.read_source(s, batch.SourceSpec("raw", "path", d), "supplier").select("s_suppkey", "s_name"), "SELECT s_suppkey, s_name FROM supplier")


def ingest_query(s: SparkSession, d: str) -> DataFrame:
    """Replace, append, then merge by key, twice: corrected totals win, of a key's rows the greatest; a null key is a key."""
    a, target, schema = _path(s, "drop"), _path(s, "orders"), "o_orderkey bigint, o_orderstatus string, cents bigint"
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    rows.where("o_orderkey % 2 = 0").write.csv(f"{a}/one", header=True)
    rows.where("o_orderkey % 2 = 1").write.csv(f"{a}/two", header=True)
    corrected = rows.where("o_orderkey % 5 = 0").withColumn("cents", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))))
    unkeyed = rows.where("o_orderkey = 10").select(F.lit(None).cast("bigint").alias("o_orderkey"), "o_orderstatus", F.lit(7).cast("bigint").alias("cents"))
    corrected.unionByName(unkeyed).write.csv(f"{a}/three", header=True)
    for name, method in (("one", "replace"), ("two", "append"), ("three", "merge"), ("three", "merge")):
        out = batch.ingest_files(s, f"{a}/{name}", "*.csv", "csv", schema, method, target, ["o_orderkey"], "cents")
    return out


register("ingest_files", ingest_query, "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE round(o_totalprice * 100)::BIGINT END AS cents FROM orders UNION ALL SELECT NULL, o_orderstatus, 7 FROM orders WHERE o_orderkey = 10")


def export_query(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "export")
    for day in ("2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-03 00:00:00"):
        batch.export_files(table(s, d, "part").select("p_partkey", "p_brand"), path, "json", day)
    return s.read.schema("p_partkey bigint, p_brand string, dt date").json(path)


register("export_files", export_query, "SELECT p_partkey, p_brand, unnest([DATE '2024-01-02', DATE '2024-01-03']) AS dt FROM part")
register("materialize", lambda s, d: batch.materialize(table(s, d, "orders"), _path(s, "mat"), "o_orderdate", "month", ["o_custkey"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least")),
         "SELECT date_trunc('month', o_orderdate)::DATE AS part, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY ALL")


def zorder_query(s: SparkSession, d: str) -> DataFrame:
    """All orders in Z-order, and whether predicates on its two columns hit fewer files together than with lexicographic order."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ordered = batch.materialize_zorder(orders, _path(s, "zorder"), ["o_custkey", "o_totalprice"], 16)
    plain = _path(s, "plain")
    orders.repartitionByRange(16, "o_custkey", "o_totalprice").write.parquet(plain)
    spans = {c: orders.agg(F.percentile_approx(c, [0.4, 0.45])).first()[0] for c in ("o_custkey", "o_totalprice")}
    hit = [sum(batch.files_hit(t, c, *v) for c, v in spans.items()) for t in (ordered, s.read.parquet(plain))]
    return ordered.withColumn("fewer_files", F.lit(hit[0] < hit[1]))


register("materialize_zorder", zorder_query, "SELECT o_orderkey, o_custkey, o_totalprice, true AS fewer_files FROM orders")
register("materialize_rows", lambda s, d: batch.materialize(table(s, d, "orders"), _path(s, "mat"), "o_orderdate", "month", ["o_custkey"]).select("o_orderkey", "o_custkey", "o_totalprice", "part"),
         "SELECT o_orderkey, o_custkey, o_totalprice, date_trunc('month', o_orderdate)::DATE AS part FROM orders")


def catalogue_query(s: SparkSession, d: str) -> DataFrame:
    """A source whose tables are in the catalogue."""
    table(s, d, "orders").createOrReplaceTempView("source_orders")
    return batch.read_source(s, batch.SourceSpec("shop", "table", ""), "source_orders").select("o_orderkey", "o_orderstatus")


register("read_source_catalogue", catalogue_query, "SELECT o_orderkey, o_orderstatus FROM orders")


def state_log_query(s: SparkSession, d: str) -> DataFrame:
    """The state log appended in four parts and compacted after the second and third."""
    log, rows = StateLog(s, _path(s, "statelog")), frame(s, d, "state_log")
    n = rows.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        log.append(rows.where(f"seq >= {n * k // 4} AND seq < {n * (k + 1) // 4}"))
        if k in (1, 2):
            log.compact(AS_OF)
    return log.state()


register("state_log_compacted", state_log_query,
         """, f AS (SELECT asset, interval_start, min(seq) AS first, max(seq) AS last_open FROM state_log WHERE status = 'in_progress' GROUP BY ALL),
         l AS (SELECT s.*, f.last_open FROM state_log s JOIN f ON f.asset = s.asset AND f.interval_start = s.interval_start AND s.seq >= f.first)
         SELECT asset, interval_start, arg_max(status, seq) AS status, arg_max(run_id, seq) AS run_id, max("at") FILTER (WHERE seq = last_open) AS started_at, CASE WHEN arg_max(status, seq) <> 'in_progress' THEN arg_max("at", seq) END AS completed_at FROM l GROUP BY asset, interval_start""", "state_log")


def load_stats_query(s: SparkSession, d: str) -> DataFrame:
    """Counters that the write itself has observed, next to the rows read back."""
    import uuid

    path = _path(s, "stats")
    rows, seen = batch.load_stats(table(s, d, "events"), f"load-{uuid.uuid4().hex}", "ts")
    rows.write.parquet(path)
    told = seen.get
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("read_back")).withColumns({"rows": F.lit(told["rows"]).cast("bigint"), "min_time": F.lit(told["min_time"]).cast("timestamp_ntz"), "max_time": F.lit(told["max_time"]).cast("timestamp_ntz")})


register("load_stats", load_stats_query, "SELECT count(*) AS read_back, count(*) AS rows, min(ts) AS min_time, max(ts) AS max_time FROM events")


def multi_output_query(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "multi")
    kinds = ("click", "error", "view")
    batch.multi_output(table(s, d, "events"), {k: lambda df, k=k: df.where(F.col("event_type") == k).select("event_id", "event_type") for k in kinds}, lambda k, df: df.write.parquet(f"{path}/kind={k}"))
    return s.read.parquet(path).select("event_id", "event_type", "kind")


register("multi_output", multi_output_query, "SELECT event_id, event_type, event_type AS kind FROM events WHERE event_type IN ('click', 'error', 'view')")


def reuse_query(s: SparkSession, d: str) -> DataFrame:
    """Two calls for one source and day compute it once; another day is computed for itself."""
    kept, calls = files.Results(s, _path(s, "results")), []
    path = _path(s, "multi")

    def source(day: int):
        return lambda: calls.append(day) or table(s, d, "events").where(F.dayofmonth("ts") == day).select("event_id", "event_type")

    for day, kind in ((3, "click"), (3, "view"), (4, "click")):
        kept.outputs("events", day, source(day), {kind: lambda df, kind=kind: df.where(F.col("event_type") == kind)}, lambda k, df, day=day: df.write.parquet(f"{path}/kind={k}/day={day}"))
    return s.read.parquet(path).select("event_id", "kind", "day").withColumn("computed", F.lit(len(calls)))


register("multi_output_once", reuse_query, "SELECT event_id, event_type AS kind, day(ts)::INTEGER AS day, 2::INTEGER AS computed FROM events WHERE (day(ts) = 3 AND event_type IN ('click', 'view')) OR (day(ts) = 4 AND event_type = 'click')")


def archive_rows_query(s: SparkSession, d: str) -> DataFrame:
    """Every line of the archive, and its place."""
    path = _path(s, "archive")
    batch.archive_runs(_runs(s, d), _events(s, d).withColumnRenamed("timestamp", "happened_at"), path)
    schema = "kind string, run_id bigint, event_id bigint, status string, asset string, duration_ms bigint, pipeline string, year int, month int"
    return s.read.schema(schema).json(path)


register("archive_rows", archive_rows_query,
         _RUNS + """SELECT 'run' AS kind, run_id, NULL::BIGINT AS event_id, status, NULL AS asset, NULL::BIGINT AS duration_ms, pipeline, year(started_at)::INTEGER AS year, month(started_at)::INTEGER AS month FROM runs
         UNION ALL SELECT 'event', e.run_id, e.event_id, NULL, e.asset, e.duration_ms, e.pipeline, year(r.started_at)::INTEGER, month(r.started_at)::INTEGER FROM run_events e JOIN runs r ON r.run_id = e.run_id""", "run_events")


def archive_query(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "archive")
    batch.archive_runs(_runs(s, d), _events(s, d).withColumnRenamed("timestamp", "happened_at"), path)
    return s.read.schema("kind string, run_id bigint, pipeline string, year int, month int").json(path).groupBy("pipeline", "year", "month", "kind").agg(F.count(F.lit(1)).alias("n"))


register("archive_runs", archive_query,
         _RUNS + """SELECT pipeline, year(begun)::INTEGER AS year, month(begun)::INTEGER AS month, kind, count(*) AS n FROM (SELECT pipeline, started_at AS begun, 'run' AS kind FROM runs UNION ALL SELECT e.pipeline, r.started_at, 'event' FROM run_events e JOIN runs r ON r.run_id = e.run_id) GROUP BY ALL""", "run_events")


def _event_files(s: SparkSession, d: str) -> str:
    """The run events as JSON files, for the streams to find."""
    path = _path(s, "found")
    _events(s, d).write.json(path)
    return path


_EVENT_SCHEMA = "event_id bigint, run_id bigint, pipeline string, asset string, event_type string, severity string, `timestamp` timestamp_ntz, duration_ms bigint, details string"


def ingest_stream_query(s: SparkSession, d: str) -> DataFrame:
    target = _path(s, "stream")
    flows.ingest_stream(s, _event_files(s, d), "*.json", "json", _EVENT_SCHEMA, target, _path(s, "mark")).awaitTermination()
    return s.read.parquet(target).select("event_id", "run_id", "event_type")


register("ingest_stream", ingest_stream_query, "SELECT event_id, run_id, event_type FROM run_events", "run_events")


def unique_stream_query(s: SparkSession, d: str) -> DataFrame:
    """All files come twice under other names, a third of the events once more in a later run; files of batches that are done are moved away."""
    found, target, mark, away = _path(s, "found"), _path(s, "unique"), _path(s, "mark"), _path(s, "away")
    rows = _events(s, d)
    for part in (rows, rows.where("event_id % 2 = 0")):
        part.write.mode("append").json(found)
    flows.ingest_stream(s, found, "*.json", "json", _EVENT_SCHEMA, target, mark, away, unique=["event_id"], time_column="timestamp", delay="60 days", max_files=4).awaitTermination()
    rows.where("event_id % 3 = 0").write.mode("append").json(found)
    flows.ingest_stream(s, found, "*.json", "json", _EVENT_SCHEMA, target, mark, away, unique=["event_id"], time_column="timestamp", delay="60 days", max_files=4).awaitTermination()
    moved = s.read.option("recursiveFileLookup", True).text(away).select(F.col("_metadata.file_path")).distinct().count() > 0
    return s.read.parquet(target).select("event_id", "run_id", "event_type").withColumn("files_moved", F.lit(moved))


register("ingest_stream_unique", unique_stream_query, "SELECT event_id, run_id, event_type, true AS files_moved FROM run_events", "run_events")


def alarm_query(s: SparkSession, d: str) -> DataFrame:
    """Completions of event types in files by time, read a file a batch in two runs of one checkpoint."""
    found, target, mark = _path(s, "found"), _path(s, "alarms"), _path(s, "mark")
    done = table(s, d, "events").where("event_type <> 'view'").select(F.concat_ws("-", "event_type", F.col("user_id") % 20).alias("asset"), F.col("ts").alias("completed_at"))
    for low, high in ((0, 9), (9, 18), (18, 40)):
        done.where(f"day(completed_at) > {low} AND day(completed_at) <= {high}").coalesce(2).write.mode("append").json(found)
        stream = flows.file_stream(s, found, "*.json", "json", "asset string, completed_at timestamp", max_files=1)
        freshness.freshness_alarms(stream, 30, "12 days").writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(freshness.ALARMS).parquet(target).select("asset", F.col("last_completed").cast("timestamp_ntz").alias("last_completed"), F.col("due_at").cast("timestamp_ntz").alias("due_at"))


register("freshness_alarms", alarm_query,
         """WITH done AS (SELECT event_type || '-' || (user_id % 20) AS asset, date_trunc('millisecond', ts) AS t FROM events WHERE event_type <> 'view'), mark AS (SELECT max(t) - INTERVAL 12 DAY AS m FROM done),
         gaps AS (SELECT asset, t, t + INTERVAL 30 HOUR AS due, lead(t) OVER (PARTITION BY asset ORDER BY t) AS next FROM done)
         SELECT asset, t AS last_completed, due AS due_at FROM gaps, mark WHERE due < m AND (next IS NULL OR next > due)""")


def event_sink_query(s: SparkSession, d: str) -> DataFrame:
    runs, failures = _path(s, "runs"), _path(s, "failures")
    stream = flows.file_stream(s, _event_files(s, d), "*.json", "json", _EVENT_SCHEMA, max_files=2)
    flows.event_sink_stream(stream, runs, failures, _path(s, "mark")).awaitTermination()
    schema = "event_id bigint, `key` string"
    both = [s.read.schema(schema).json(p).select("event_id", "key", F.lit(k).alias("sink")) for p, k in ((runs, "runs"), (failures, "failures"))]
    return both[0].unionByName(both[1])


register("event_sink_stream", event_sink_query,
         """, k AS (SELECT *, pipeline || ':' || run_id AS key FROM run_events)
         SELECT event_id, key, 'runs' AS sink FROM k UNION ALL SELECT event_id, key, 'failures' FROM k WHERE event_type = 'asset_failed' OR json_extract_string(details, '$.status') = 'completed_with_failures'""", "run_events")
