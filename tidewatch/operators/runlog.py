"""Analytics over an event table: event_id, run_id, pipeline, asset, event_type, severity, timestamp, duration_ms, details (JSON).

Every question about many runs is one pass with one shuffle; counts combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment, ratio

LEVELS = {"info": 1, "warning": 2, "error": 3, "critical": 4}
FAILED = ("asset_failed", "node_failed")
SUCCEEDED = ("asset_succeeded", "node_succeeded")
SKIPPED = ("asset_skipped", "node_skipped")


def _detail(path: str) -> Column:
    return F.get_json_object("details", f"$.{path}")


def _error() -> Column:
    """The error text of a failed node."""
    return _detail("error_message")


def event_filter(events: DataFrame, run_id=None, pipeline=None, asset=None, event_types: str | None = None, min_severity: str | None = None, since=None, until=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Events by any of the conditions, oldest first (ties: event_id). An unknown severity is no condition."""
    out = events
    for c, v in (("run_id", run_id), ("pipeline", pipeline), ("asset", asset)):
        if v is not None:
            out = out.where(F.col(c) == v)
    if event_types:
        out = out.where(F.col("event_type").isin([x.strip() for x in event_types.split(",")]))
    if min_severity:
        out = out.where(F.col("severity").isin([s for s, n in LEVELS.items() if n >= LEVELS[min_severity]]) if min_severity in LEVELS else F.lit(True))
    if since is not None:
        out = out.where(F.col("timestamp") >= moment(since))
    if until is not None:
        out = out.where(F.col("timestamp") <= moment(until))
    if limit is None and not offset:
        return out
    out = out.orderBy("timestamp", "event_id").offset(offset)
    return out if limit is None else out.limit(limit)


def run_summary(events: DataFrame) -> DataFrame:
    """One row a started run, by its last end event; without an end it is running.

    ``run_completed``: status and duration_seconds of the details (empty, 0); ``run_failed``: failed, and duration_ms. Counts are those of run_completed.
    """
    start, done = F.col("event_type") == "run_started", F.col("event_type").isin("run_completed", "run_failed")
    last = F.max_by(F.struct("event_type", "timestamp", "duration_ms", "details"), F.when(done, F.struct("timestamp", "event_id")))
    told = F.max_by("details", F.when(F.col("event_type") == "run_completed", F.struct("timestamp", "event_id")))
    rows = events.where(start | done).groupBy("run_id").agg(F.first("pipeline").alias("pipeline"), F.min(F.when(start, F.col("timestamp"))).alias("started_at"), last.alias("e"), told.alias("told"))
    rows = rows.where("started_at IS NOT NULL").select("run_id", "pipeline", "started_at", "e.*", "told")
    ended, failed = F.col("event_type").isNotNull(), F.col("event_type") == "run_failed"
    status = F.when(~ended, "running").when(failed, "failed").otherwise(F.coalesce(_detail("status"), F.lit("")))
    seconds = F.when(failed, F.coalesce(F.col("duration_ms") / 1000, F.lit(0.0))).when(ended, F.coalesce(_detail("duration_seconds").cast("double"), F.lit(0.0)))
    counts = [F.when(ended, F.coalesce(F.get_json_object("told", f"$.{c}").cast("int"), F.lit(0))).alias(c) for c in ("succeeded", "failed", "skipped", "total_nodes")]
    return rows.select("run_id", "pipeline", "started_at", F.col("timestamp").alias("completed_at"), status.alias("status"), seconds.alias("duration_s"), *counts)


def list_runs(events: DataFrame, n: int = 20) -> DataFrame:
    """The newest runs by start."""
    return run_summary(events).orderBy(F.desc("started_at"), "run_id").limit(n)


def run_history(runs: DataFrame, pipeline: str, since, statuses: list[str] | None = None, n: int = 20) -> DataFrame:
    out = runs.where((F.col("pipeline") == pipeline) & (F.col("started_at") >= moment(since)))
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    return out.orderBy(F.desc("started_at"), "run_id").limit(n)


def active_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.where("status = 'running'").orderBy(F.desc("started_at"), "run_id").limit(n)


def failed_nodes(events: DataFrame, run_id=None) -> DataFrame:
    out = events.where(F.col("event_type").isin(*FAILED))
    return (out if run_id is None else out.where(F.col("run_id") == run_id)).select("run_id", "asset").distinct()


def node_results(events: DataFrame) -> DataFrame:
    """Status, duration, error and metadata (map) of every node event."""
    status = F.when(F.col("event_type").isin(*SUCCEEDED), "success").when(F.col("event_type").isin(*FAILED), "failed").when(F.col("event_type").isin(*SKIPPED), "skipped")
    return events.select("event_id", "run_id", "asset", status.alias("status"), "duration_ms", _error().alias("error"), F.from_json(_detail("metadata"), "map<string,string>").alias("metadata")).where("status IS NOT NULL")


def check_results(events: DataFrame, asset: str | None = None) -> DataFrame:
    """The events of checks that passed or failed, for all assets or one (its own name, or that of its nodes check:<asset>:<check>)."""
    out = events.where(F.col("event_type").isin("check_passed", "check_failed"))
    if asset is not None:
        out = out.where((F.col("asset") == asset) | F.col("asset").startswith(f"check:{asset}:"))
    return out.withColumn("status", F.regexp_replace("event_type", "^check_", ""))


def last_success(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*SUCCEEDED)).groupBy("asset").agg(F.max("timestamp").alias("last_success"))


def run_cost(events: DataFrame) -> DataFrame:
    """Bytes, cost, queried nodes, cached nodes and hit rate (0 without nodes) of each run. Only nodes whose bytes
    parse count, for the cost as well; a cost that doesn't parse is 0."""
    rows = events.where(F.col("event_type").isin(*SUCCEEDED)).select("run_id", F.expr("try_cast(get_json_object(details, '$.metadata.total_bytes_processed') AS bigint)").alias("b"), F.expr("try_cast(get_json_object(details, '$.metadata.estimated_cost_usd') AS decimal(18,6))").alias("c"), (_detail("metadata.cache_hit") == "true").alias("hit"))
    out = rows.groupBy("run_id").agg(F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("c"))), F.lit(0)).cast("double").alias("total_cost"), F.count("b").alias("query_nodes"), F.count_if(F.col("b").isNotNull() & F.col("hit")).alias("cached_nodes"))
    return out.withColumn("hit_rate", F.coalesce(ratio(F.col("cached_nodes"), F.col("query_nodes")), F.lit(0.0)))


def node_stats(events: DataFrame, since) -> DataFrame:
    """Runs, successes, failures, success rate and average duration (whole ms) of each node."""
    ok, bad = F.col("event_type").isin(*SUCCEEDED), F.col("event_type").isin(*FAILED)
    rows = events.where((ok | bad) & (F.col("timestamp") >= moment(since)))
    out = rows.groupBy("pipeline", "asset").agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("successes"), F.count_if(bad).alias("failures"), F.sum("duration_ms").alias("ms"))
    return out.select("pipeline", "asset", "runs", "successes", "failures", ratio(F.col("successes"), F.col("runs")).alias("success_rate"), F.expr("ms div runs").alias("avg_duration_ms"))


def top_errors(events: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent error texts of each node (ties: the text)."""
    from pyspark.sql import Window

    counts = events.where(F.col("event_type").isin(*FAILED)).groupBy("asset", F.coalesce(_error(), F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("n"), "error"))).where(F.col("rank") <= n)


def failure_report(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Failed or crashed runs with their failed node events, one row an event (runs without any keep one row)."""
    bad = runs.where(F.col("status").isin("failed", "crashed", "completed_with_failures")).select("run_id", "pipeline", "status")
    nodes = events.where(F.col("event_type").isin(*FAILED)).select("run_id", "event_id", "asset", _error().alias("error"))
    return bad.join(nodes, "run_id", "left")


def run_rollup(events: DataFrame) -> DataFrame:
    """Counts of outcomes, cost, failed assets, their errors and a summary text of each run with node events.

    The texts hold a run's failed nodes only; nodes without an error text are not among the errors.
    """
    ended = F.col("event_type").isin("run_completed", "run_failed")
    status = F.when(F.col("event_type").isin(*SUCCEEDED), "success").when(F.col("event_type").isin(*FAILED), "failed").when(F.col("event_type").isin(*SKIPPED), "skipped")
    cost = F.expr("try_cast(get_json_object(details, '$.metadata.estimated_cost_usd') AS decimal(18,6))")
    seconds = F.when(ended, F.coalesce(_detail("duration_seconds").cast("double"), F.col("duration_ms") / 1000))
    rows = events.select("run_id", "event_id", "pipeline", "asset", status.alias("status"), F.nullif(_error(), F.lit("")).alias("error"), cost.alias("cost"), seconds.alias("seconds")).where("status IS NOT NULL OR seconds IS NOT NULL")
    item = F.struct("asset", "event_id", F.concat(F.col("asset"), F.lit(": "), F.substring("error", 1, 200)).alias("text"))
    out = rows.groupBy("run_id").agg(
        F.min("pipeline").alias("pipeline"), *(F.count_if(F.col("status") == x).alias(y) for x, y in (("success", "succeeded"), ("failed", "failed"), ("skipped", "skipped"))),
        F.coalesce(F.sum(F.when(F.col("status").isNotNull(), F.col("cost"))), F.lit(0)).cast("double").alias("total_cost"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("duration_s"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "failed", item))).alias("items"),
    )
    return out.where(F.col("succeeded") + F.col("failed") + F.col("skipped") > 0).select(
        "run_id", "succeeded", "failed", "skipped", "total_cost",
        F.when(F.col("failed") > 0, "completed_with_failures").otherwise("success").alias("status"),
        F.array_join(F.transform("items", lambda x: x["asset"]), ",").alias("failed_assets"),
        F.array_join(F.transform("items", lambda x: x["text"]), "; ").alias("errors"),
        F.format_string("%s: %d succeeded, %d failed, %d skipped (%.0fs)", "pipeline", "succeeded", "failed", "skipped", "duration_s").alias("summary"),
    )


#: Error classes and the texts that tell them, case as written; the first class that matches counts. Fixed values.
ERROR_CLASSES = (
    ("rate_limit", ("429", "rate limit", "rateLimitExceeded", "Exceeded rate limits", "Too Many Requests")),
    ("quota", ("quotaExceeded", "quota exceeded", "RESOURCE_EXHAUSTED", "Quota exceeded")),
    ("network", ("connection reset", "connection refused", "no such host", "DNS", "dial tcp", "UNAVAILABLE", "transport is closing", "EOF", "broken pipe")),
    ("timeout", ("context deadline exceeded", "deadline exceeded", "408", "504", "Request Timeout", "Gateway Timeout")),
    ("server", ("500", "502", "503", "INTERNAL", "Internal Server Error", "Bad Gateway", "Service Unavailable", "backendError", "internalError")),
)


def error_class(error: Column) -> Column:
    out, text = F.when(F.lit(False), ""), F.coalesce(error, F.lit(""))
    for name, parts in ERROR_CLASSES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        out = out.when(hit, name)
    return out.otherwise("none")


def is_retryable(error: str, classes: tuple[str, ...] = ()) -> bool:
    """Whether an error's text belongs to a class that is retried; no classes given: to any."""
    found = next((name for name, parts in ERROR_CLASSES if any(p in error for p in parts)), None)
    return found is not None and (not classes or found in classes)


def error_breakdown(events: DataFrame, retryable: tuple[str, ...] = ()) -> DataFrame:
    """Failed nodes by class, and whether a policy retries it; an empty policy retries every class but ``none``."""
    retryable = retryable or tuple(name for name, _ in ERROR_CLASSES)
    rows = events.where(F.col("event_type").isin(*FAILED)).select(error_class(_error()).alias("error_class"))
    return rows.groupBy("error_class").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", F.col("error_class").isin(*retryable))


def duration_histogram(rows: DataFrame, seconds: Column, base: float, labels: list[str], factor: float = 2, n: int = 15) -> DataFrame:
    """Cumulative counts (labels, le, n) in n buckets base * factor^k and +Inf; one conditional aggregate."""
    bounds = [base * factor**k for k in range(n)]
    counts = rows.groupBy(*labels).agg(*(F.count_if(seconds <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(seconds).alias("all"))
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select(*labels, F.explode(F.array(*cells)).alias("r")).select(*labels, "r.*")


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline", "status").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("total_nodes"), F.lit(0)).cast("bigint").alias("nodes"))


def retention_delete(events: DataFrame, cutoff) -> DataFrame:
    """The events that stay."""
    return events.where(F.col("timestamp") >= moment(cutoff))


def prune_archived(runs: DataFrame, events: DataFrame, archive: DataFrame, as_of, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(runs, events) without ended runs that are older than ``days`` and archived (run_id)."""
    old = runs.where((F.col("status") != "running") & (F.col("completed_at") < moment(as_of) - F.make_dt_interval(days=F.lit(days))))
    gone = old.select("run_id").join(archive.select("run_id"), "run_id", "left_semi")
    return runs.join(gone, "run_id", "left_anti"), events.join(gone, "run_id", "left_anti")


def prune_intervals(state: DataFrame, as_of, days: int = 90) -> DataFrame:
    """The interval states (status, completed_at) that stay: all but those complete for more than ``days``."""
    old = (F.col("status") == "complete") & (F.col("completed_at") < moment(as_of) - F.make_dt_interval(days=F.lit(days)))
    return state.where(~F.coalesce(old, F.lit(False)))
