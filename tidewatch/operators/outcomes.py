"""What check and asset outcomes mean for a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment
from tidewatch.operators.lineage import descendants


def check_signal(results: DataFrame, checks: DataFrame) -> DataFrame:
    """Status after severity: info and warning failures succeed, critical ones block and halt the run.

    ``results``: check_name, status; ``checks``: check_name, severity, blocking.
    """
    failed = F.col("status") == "failed"
    signal = F.when(~failed, F.col("status")).when(F.col("severity").isin("info", "warning"), "success").otherwise("failed")
    return results.join(checks, "check_name").select(
        "check_name", "severity", signal.alias("signal"),
        (failed & (F.col("blocking") | (F.col("severity") == "critical")) & F.col("severity").isin("error", "critical")).alias("blocks"),
        (failed & (F.col("severity") == "critical")).alias("halts_run"),
    )


def blocked_assets(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """asset and reason of everything below failed nodes.

    ``failed``: asset, reason, where a blocking check is listed under the asset that it checks as
    ``blocked_by_check:<name>``. Of several reasons the smallest (level from the failure, then text) counts.
    """
    reached = descendants(edges, failed.select(F.col("asset").alias("node"), F.col("reason").alias("tag")), carry="tag")
    best = reached.groupBy("node").agg(F.min(F.struct("level", "tag")).alias("m"))
    return best.select(F.col("node").alias("asset"), F.col("m.tag").alias("reason"))


def skipped_assets(edges: DataFrame, results: DataFrame) -> DataFrame:
    """asset, reason, blocked_by_check of the nodes that a run skips.

    ``results``: asset, status, seq (order in which results came), severity and blocking (of checks, else null). A failed node skips all below it; a failed check that
    blocks (blocking or critical) also skips all below the assets that it checks, that is, its parents. The result that came first gives the reason; one result's own
    dependants come before those of its parents. Nodes with a result of their own are not skipped; failed checks of severity info and warning count as passed.
    """
    check = F.col("asset").startswith("check:")
    failed = results.where((F.col("status") == "failed") & ~(check & F.coalesce(F.col("severity").isin("info", "warning"), F.lit(False))))
    blocks = check & (F.coalesce("blocking", F.lit(False)) | (F.coalesce("severity", F.lit("")) == "critical"))
    tag = F.format_string("%019d%d%s", F.col("seq"), F.col("step"), F.col("asset"))
    own = failed.withColumn("step", F.lit(0)).select(F.col("asset").alias("node"), tag.alias("tag"))
    above = failed.where(blocks).withColumn("step", F.lit(1)).join(edges.select(F.col("child").alias("asset"), F.col("parent").alias("node")), "asset").select("node", tag.alias("tag"))
    reached = descendants(edges, own.unionByName(above), carry="tag").groupBy("node").agg(F.min("tag").alias("tag"))
    told = reached.join(results.select(F.col("asset").alias("node")), "node", "left_anti").withColumns({"step": F.substring("tag", 20, 1), "by": F.expr("substring(tag, 21)")})
    blocked = F.col("step") == "1"
    reason = F.when(blocked, F.concat(F.lit("skipped: blocked_by_check:"), "by")).otherwise(F.concat(F.lit("skipped: dependency "), F.col("by"), F.lit(" failed")))
    return told.select(F.col("node").alias("asset"), reason.alias("reason"), F.when(blocked, F.col("by")).alias("blocked_by_check"))


def check_errors(results: DataFrame, pipeline: str, run_at) -> DataFrame:
    """Current errors from check results (node, status, message): failed are errors, skipped are warnings.

    Names are ``check:<asset>:<rest>``; the rest may hold colons, and nodes without it are no checks. The details hold
    status, error and, where the results have them, stdout, stderr and the entries of metadata (a map, whose values count before the others), by name. These rows replace those of the run before (write them with ``overwrite``).
    """
    parts = F.split("node", ":", 3)
    told = [F.struct(F.lit(c).alias("key"), F.col(x).cast("string").alias("value")) for c, x in (("error", "message"), ("status", "status"), ("stdout", "stdout"), ("stderr", "stderr")) if x in results.columns]
    own = F.filter(F.array(*told), lambda e: e["value"] != "")
    if "metadata" in results.columns:
        more = F.coalesce(F.map_entries("metadata"), F.array().cast("array<struct<key: string, value: string>>"))
        own = F.concat(F.filter(own, lambda e: ~F.coalesce(F.map_contains_key("metadata", e["key"]), F.lit(False))), more)
    rows = results.where(F.col("node").startswith("check:") & (F.size(parts) == 3) & F.col("status").isin("failed", "skipped"))
    return rows.select(
        F.lit(pipeline).alias("pipeline"),
        F.get(parts, F.lit(1)).alias("asset"),
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("check_name"),
        F.when(F.col("status") == "failed", "error").otherwise("warning").alias("severity"),
        F.coalesce(F.nullif("message", F.lit("")), F.concat_ws(" ", "node", "status")).alias("message"),
        F.to_json(F.map_from_entries(F.array_sort(own))).alias("details_json"),
        moment(run_at).alias("run_at"),
    )
