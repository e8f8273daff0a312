"""Registered queries of the library and their oracle SQL, one entry per operator.

Inputs are the given tables or the fixtures derived from them (see ``fixtures``); everything reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import cast_to_currency, moment, sql_function
from tidewatch.operators import checks, digests, intervals, models, monitor, outcomes, suite
from tidewatch.plans.fixtures import AS_OF, cte, frame, table
from tidewatch.sources.scratch import shared_folder
from tidewatch.sources.slices import rule_audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, uses: str = "") -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = (cte(*uses.split()) + "\n" if uses else "") + sql


def _path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


# ---- checks -------------------------------------------------------------------------------------------------

register("unique_grain", lambda s, d: checks.unique_grain(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], None),
         "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL HAVING count(*) > 1")
register("not_null_grain", lambda s, d: checks.not_null_grain(frame(s, d, "staged").select("o_orderkey", "priority"), ["priority"], None),
         "SELECT o_orderkey, priority FROM staged WHERE priority IS NULL", "staged")
register("not_empty", lambda s, d: checks.not_empty(table(s, d, "orders").where("o_totalprice < 0")),
         "SELECT 'EMPTY_TABLE' AS issue_type, 0::BIGINT AS row_count WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
register("row_count_nonzero", lambda s, d: checks.row_count_nonzero(table(s, d, "orders").where("o_orderkey < 0")),
         "SELECT 'empty' AS issue_type, count(*) AS row_count FROM orders WHERE o_orderkey < 0 HAVING count(*) = 0")
register("no_future_timestamps", lambda s, d: checks.no_future_timestamps(frame(s, d, "staged"), ["o_orderkey"], "created_at", "updated_at", "2000-06-01 00:00:00", None),
         "SELECT o_orderkey, created_at, updated_at, CASE WHEN created_at > TIMESTAMP '2000-06-01' THEN 'FUTURE_CREATED_AT' ELSE 'FUTURE_UPDATED_AT' END AS issue_type FROM staged WHERE created_at > TIMESTAMP '2000-06-01' OR updated_at > TIMESTAMP '2000-06-01'", "staged")
register("updated_gte_created", lambda s, d: checks.updated_gte_created(frame(s, d, "staged"), ["o_orderkey"], "created_at", "updated_at", "1998-01-01 00:00:00", None),
         "SELECT o_orderkey, created_at, updated_at, 'UPDATED_BEFORE_CREATED' AS issue_type FROM staged WHERE updated_at < created_at AND created_at > TIMESTAMP '1998-01-01'", "staged")
register("source_completeness", lambda s, d: checks.source_completeness(table(s, d, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey", table(s, d, "orders").where("o_orderkey % 11 <> 0"), "o_orderkey", "o_orderdate", "2001-01-01 05:00:00", None),
         """WITH a AS (SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderdate < DATE '2001-01-01'), b AS (SELECT DISTINCT o_orderkey AS pk FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderdate < DATE '2001-01-01')
         SELECT pk, 'MISSING_FROM_STAGING' AS issue_type FROM (FROM a EXCEPT FROM b) UNION ALL SELECT pk, 'MISSING_FROM_SOURCE' FROM (FROM b EXCEPT FROM a)""")
register("fan_out", lambda s, d: checks.fan_out(table(s, d, "lineitem"), table(s, d, "orders")),
         "SELECT *, 'FAN_OUT_DETECTED' AS issue_type FROM (SELECT (SELECT count(*) FROM lineitem) AS table_row_count, (SELECT count(*) FROM orders) AS upstream_row_count) WHERE table_row_count > upstream_row_count")
register("row_retention", lambda s, d: checks.row_retention(table(s, d, "orders").where("o_orderstatus = 'P'"), table(s, d, "orders")),
         "SELECT *, table_row_count / nullif(upstream_row_count, 0) AS retention_ratio, 'SUSPICIOUS_ROW_LOSS' AS issue_type FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS table_row_count, count(*) AS upstream_row_count FROM orders) WHERE table_row_count / nullif(upstream_row_count, 0) < 0.5")
register("contract_pk", lambda s, d: checks.contract_pk(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"], None),
         "SELECT l_orderkey, l_partkey, count(*) AS duplicate_count, 'PK_NOT_UNIQUE' AS issue_type FROM lineitem GROUP BY ALL HAVING count(*) > 1")
register("contract_not_null", lambda s, d: checks.contract_not_null(frame(s, d, "staged"), "priority", ["o_orderkey"], None),
         "SELECT o_orderkey, 'priority' AS column_name, 'NULL_VALUE' AS issue_type FROM staged WHERE priority IS NULL", "staged")
register("contract_accepted_values", lambda s, d: checks.contract_accepted_values(table(s, d, "orders"), "o_orderstatus", ["F", "O"], ["o_orderkey"], None),
         "SELECT o_orderkey, o_orderstatus AS value, 'UNACCEPTED_VALUE' AS issue_type FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')")
register("fk_not_null", lambda s, d: checks.fk_not_null(frame(s, d, "contacts"), ["c_custkey"], "nation_key", None),
         "SELECT c_custkey, 'nation_key' AS fk_column, 'FK_IS_NULL' AS issue_type FROM contacts WHERE nation_key IS NULL", "contacts")
register("fk_integrity", lambda s, d: checks.fk_integrity(table(s, d, "orders"), ["o_orderkey"], "o_custkey", table(s, d, "customer").where("c_acctbal >= 0"), "c_custkey", None),
         "SELECT o_orderkey, o_custkey AS fk_value, 'ORPHAN_FK' AS issue_type FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal >= 0 AND c_custkey = o_custkey)")
register("completeness", lambda s, d: checks.completeness(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey", [(table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")], [(table(s, d, "supplier"), "s_suppkey")]),
         """WITH e AS ((SELECT c_custkey AS k FROM customer EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION SELECT s_suppkey FROM supplier), a AS (SELECT DISTINCT o_custkey AS k FROM orders),
         n AS (SELECT (SELECT count(*) FROM e) AS expected_count, (SELECT count(*) FROM a) AS entity_count, (SELECT count(*) FROM e WHERE k NOT IN (FROM a)) AS missing_count, (SELECT count(*) FROM a WHERE k NOT IN (FROM e)) AS unexpected_count)
         SELECT *, (missing_count + unexpected_count) / nullif(expected_count, 0) AS drift_ratio, 'COMPLETENESS_IMBALANCE' AS issue_type FROM n WHERE (missing_count + unexpected_count) / nullif(expected_count, 0) > 0.01""")
register("standard_email", lambda s, d: checks.standard_email(frame(s, d, "contacts"), "email", ["c_custkey"], None),
         "SELECT c_custkey, email AS value, 'EMAIL_NOT_NORMALIZED' AS issue_type FROM contacts WHERE email <> lower(trim(email))", "contacts")
register("standard_phone", lambda s, d: checks.standard_phone(frame(s, d, "contacts"), "phone", ["c_custkey"], None),
         r"SELECT c_custkey, phone AS value, 'PHONE_FORMAT_INVALID' AS issue_type FROM contacts WHERE NOT regexp_full_match(phone, '1-\d{3}-\d{3}-\d{4}')", "contacts")
register("standard_currency", lambda s, d: checks.standard_currency(frame(s, d, "priced"), "amount", ["l_orderkey", "l_linenumber", "l_partkey"], None).withColumn("value", F.col("value").cast("double")),
         "SELECT l_orderkey, l_linenumber, l_partkey, amount::DOUBLE AS value, 'CURRENCY_NOT_ROUNDED' AS issue_type FROM priced WHERE amount <> round(amount, 2)", "priced")
register("source_not_empty", lambda s, d: checks.source_not_empty(table(s, d, "supplier").where("s_suppkey < 0")),
         "SELECT 'EMPTY_OR_MISSING' AS issue_type, 0::BIGINT AS row_count WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey < 0)")
register("source_freshness", lambda s, d: checks.source_freshness(table(s, d, "events").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("micros")), "micros", 60, "2024-02-01 00:00:59"),
         "SELECT *, 'STALE_SOURCE' AS issue_type FROM (SELECT epoch_us(max(ts)) AS latest_micros, CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:59') - epoch_us(max(ts))) / 60000000) AS BIGINT) AS staleness_minutes FROM events) WHERE staleness_minutes > 60")
register("source_pk_not_null", lambda s, d: checks.source_pk_not_null(frame(s, d, "contacts"), "nation_key"),
         "SELECT count(*) AS null_count, 'NULL_PK' AS issue_type FROM contacts WHERE nation_key IS NULL HAVING count(*) > 0", "contacts")
register("source_pk_unique", lambda s, d: checks.source_pk_unique(table(s, d, "orders"), "o_custkey", None),
         "SELECT o_custkey, count(*) AS dupe_count FROM orders GROUP BY o_custkey HAVING count(*) > 1")


def _catalog(s: SparkSession, d: str, run: int = 1) -> DataFrame:
    return monitor.schema_catalog({t: table(s, d, t) for t in ("orders", "customer", "events")}, run)


_COLUMNS = "catalog AS (SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('orders', 'customer', 'events'))"
register("expected_columns", lambda s, d: checks.expected_columns(table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "orders").otherwise("customer").alias("table_name"), F.when(F.col("p_partkey") < 5, "c_name").when(F.col("p_partkey") < 10, "O_ORDERKEY").otherwise(F.col("p_name")).alias("column_name")).distinct(), _catalog(s, d)),
         f"""WITH {_COLUMNS}, e AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'orders' ELSE 'customer' END AS table_name, CASE WHEN p_partkey < 5 THEN 'c_name' WHEN p_partkey < 10 THEN 'O_ORDERKEY' ELSE p_name END AS column_name FROM part)
         SELECT *, 'COLUMN_MISSING' AS issue_type FROM e WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.table_name = e.table_name AND c.column_name = e.column_name)""")

_LAYOUT = "'t' || CAST(p_partkey AS VARCHAR(20)) AS table_name, 'c' || CAST(p_partkey % {a} AS VARCHAR(20)) AS partition_column, CASE WHEN p_partkey % 3 = 0 THEN 'DAY' ELSE '{b}' END AS partition_type, CASE WHEN p_partkey % 4 <> {c} THEN 'x,y' END AS clustering"
_SPEC, _ACTUAL = _LAYOUT.format(a=4, b="month", c=0), _LAYOUT.format(a=5, b="MONTH", c=1)
register("partition_layout", lambda s, d: checks.partition_layout(table(s, d, "part").selectExpr(*_cols(_SPEC)), table(s, d, "part").where("p_partkey <> 3").selectExpr(*_cols(_ACTUAL))),
         f"""WITH e AS (SELECT {_SPEC} FROM part), a AS (SELECT {_ACTUAL} FROM part WHERE p_partkey <> 3),
         l AS (SELECT table_name, unnest([{{'field': 'partition_column', 'expected': e.partition_column, 'actual': a.partition_column}}, {{'field': 'partition_type', 'expected': e.partition_type, 'actual': a.partition_type}}, {{'field': 'clustering', 'expected': e.clustering, 'actual': a.clustering}}]) AS r FROM e FULL JOIN a USING (table_name))
         SELECT table_name, r.field AS field, r.expected AS expected, r.actual AS actual FROM l WHERE CASE WHEN r.field = 'partition_type' THEN upper(r.expected) IS DISTINCT FROM upper(r.actual) ELSE r.expected IS DISTINCT FROM r.actual END""")


def _cols(text: str) -> list[str]:
    return [x.strip() for x in text.replace(", '", ",\n'").replace(", CASE", ",\nCASE").split(",\n")]


_SCHEMA = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 't0' ELSE 't1' END AS table_name, 'c' || CAST(p_partkey AS VARCHAR(20)) AS column_name, {t} AS data_type, CAST(p_partkey AS INT) AS ordinal FROM {p} WHERE {w}"


def _schemas(s: SparkSession, d: str, t: str, w: str) -> DataFrame:
    return s.sql(_SCHEMA.replace("{t}", t).replace("{w}", w), p=table(s, d, "part"))


def _schema_sql(t: str, w: str) -> str:
    return _SCHEMA.replace("{t}", t).replace("{w}", w).replace("{p}", "part")


_OLD, _NEW = ("p_type", "p_partkey % 7 <> 0"), ("CASE WHEN p_partkey % 5 = 0 THEN 'int' ELSE p_type END", "p_partkey % 9 <> 0")
register("schema_diff", lambda s, d: checks.schema_diff(_schemas(s, d, *_OLD), _schemas(s, d, *_NEW)),
         f"""WITH p AS ({_schema_sql(*_OLD)}), c AS ({_schema_sql(*_NEW)})
         SELECT * FROM (SELECT coalesce(p.table_name, c.table_name) AS table_name, coalesce(p.column_name, c.column_name) AS column_name, CASE WHEN c.column_name IS NULL THEN 'column_removed' WHEN p.column_name IS NULL THEN 'column_added' WHEN p.data_type <> c.data_type THEN 'type_changed' END AS change, p.data_type AS old_type, c.data_type AS new_type
         FROM p FULL JOIN c ON p.table_name = c.table_name AND p.column_name = c.column_name) WHERE change IS NOT NULL""")
register("schema_history", lambda s, d: checks.schema_history(_schemas(s, d, *_OLD).withColumn("run_seq", F.lit(1)).unionByName(_schemas(s, d, *_NEW).withColumn("run_seq", F.lit(3))), "error"),
         f"""WITH p AS ({_schema_sql(*_OLD)}), c AS ({_schema_sql(*_NEW)})
         SELECT *, 3 AS run_seq, 'error' AS severity FROM (SELECT coalesce(p.table_name, c.table_name) AS table_name, coalesce(p.column_name, c.column_name) AS column_name, CASE WHEN c.column_name IS NULL THEN 'column_removed' WHEN p.column_name IS NULL THEN 'column_added' WHEN p.data_type <> c.data_type THEN 'type_changed' END AS change, p.data_type AS old_type, c.data_type AS new_type
         FROM p FULL JOIN c ON p.table_name = c.table_name AND p.column_name = c.column_name) WHERE change IS NOT NULL""")
register("custom_check", lambda s, d: models.run_model(s, "SELECT o_orderkey, o_totalprice FROM {o} WHERE o_totalprice > :most", {"o": table(s, d, "orders")}, {"most": 400000}),
         "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")


def _suite(s: SparkSession, d: str) -> tuple[DataFrame, list[suite.Check]]:
    staged = frame(s, d, "staged").join(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").withColumn("amount", F.col("o_totalprice").cast("decimal(18,4)"))
    spec = suite.TableSpec("orders", "staging", ("o_orderkey",), "created_at", "updated_at", ("priority",), {"o_orderstatus": ("F", "O")}, {"o_custkey": (table(s, d, "customer").where("c_acctbal >= 0"), "c_custkey", False)}, currency=("amount",), since="1998-01-01 00:00:00")
    return staged, suite.check_suite(spec, staged, "2000-06-01 00:00:00")


_SUITE_SQL = """
, r(check_name, violations) AS (
    SELECT 'unique_grain', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'not_null_grain', count(*) FROM orders WHERE o_orderkey IS NULL
    UNION ALL SELECT 'not_empty', CASE WHEN EXISTS (FROM orders) THEN 0 ELSE 1 END
    UNION ALL SELECT 'no_future_timestamps', count(*) FROM staged WHERE created_at > TIMESTAMP '2000-06-01' OR updated_at > TIMESTAMP '2000-06-01'
    UNION ALL SELECT 'updated_at_gte_created_at', count(*) FROM staged WHERE updated_at < created_at AND created_at > TIMESTAMP '1998-01-01'
    UNION ALL SELECT 'not_null:priority', count(*) FROM staged WHERE priority IS NULL
    UNION ALL SELECT 'accepted_values:o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'fk_not_null:o_custkey', count(*) FROM orders WHERE o_custkey IS NULL
    UNION ALL SELECT 'fk:o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    UNION ALL SELECT 'currency:amount', count(*) FROM orders WHERE o_totalprice::DECIMAL(18,4) <> round(o_totalprice::DECIMAL(18,4), 2))
SELECT check_name, 'error' AS severity, violations, CASE WHEN violations = 0 THEN 'passed' ELSE 'failed' END AS status FROM r"""
register("check_suite", lambda s, d: suite.check_summary(*_suite(s, d)), _SUITE_SQL, "staged")


def source_query(s: SparkSession, d: str) -> DataFrame:
    """A source of one table, and one of two tables of which one is missing."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("micros")
    one = suite.SourceSpec("web", {"events": table(s, d, "events").select("*", micros)}, "user_id", 60, "micros", ("event_id", "session"))
    two = suite.SourceSpec("crm", {"customer": table(s, d, "customer"), "leads": None}, "c_custkey")
    checked = [suite.check_summary(next(x for x in spec.tables.values() if x is not None), suite.source_suite(spec, "2024-02-01 00:00:59")) for spec in (one, two)]
    return checked[0].unionByName(checked[1]).select("check_name", "violations", "status")


register("source_suite", source_query, """WITH r(check_name, violations) AS (
    SELECT 'source:web:events:exists_not_empty', CASE WHEN EXISTS (FROM events) THEN 0 ELSE 1 END
    UNION ALL SELECT 'source:web:freshness', CASE WHEN floor((epoch_us(TIMESTAMP '2024-02-01 00:00:59') - max(epoch_us(ts))) / 60000000) > 60 THEN 1 ELSE 0 END FROM events
    UNION ALL SELECT 'source:web:pk_not_null', CASE WHEN count(*) > count(user_id) THEN 1 ELSE 0 END FROM events
    UNION ALL SELECT 'source:web:pk_unique', count(*) FROM (SELECT 1 FROM events GROUP BY user_id HAVING count(*) > 1)
    UNION ALL SELECT 'source:web:expected_columns', 1
    UNION ALL SELECT 'source:crm:customer:exists_not_empty', CASE WHEN EXISTS (FROM customer) THEN 0 ELSE 1 END
    UNION ALL SELECT 'source:crm:leads:exists_not_empty', 1)
SELECT check_name, violations::BIGINT AS violations, CASE WHEN violations = 0 THEN 'passed' ELSE 'failed' END AS status FROM r""")


def check_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts beside the number of sampled rows (at most 100 a failed check)."""
    df, own = _suite(s, d)
    counts = suite.check_summary(df, own)
    samples = suite.check_samples(own, {r["check_name"] for r in counts.where("status = 'failed'").select("check_name").collect()}).groupBy("check_name").agg(F.count("sample").alias("samples"))
    return counts.join(samples, "check_name", "left").select("check_name", "status", "violations", F.coalesce("samples", F.lit(0).cast("bigint")).alias("samples"))


register("check_summary", check_summary, _SUITE_SQL.replace("SELECT check_name, 'error' AS severity, violations,", "SELECT check_name, violations, least(violations, 100) AS samples,"), "staged")

# ---- checks at size ------------------------------------------------------------------------------------------

register("source_completeness_digests", lambda s, d: digests.source_completeness(table(s, d, "orders").where("o_orderkey % 7 <> 0 OR o_orderkey % 3 <> 0"), "o_orderkey", table(s, d, "orders").where("o_orderkey % 97 <> 0"), "o_orderkey", "o_orderdate", "2001-01-01 05:00:00"),
         """SELECT o_orderkey AS pk, CASE WHEN o_orderkey % 97 = 0 THEN 'MISSING_FROM_STAGING' ELSE 'MISSING_FROM_SOURCE' END AS issue_type
         FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' AND (o_orderkey % 21 = 0) <> (o_orderkey % 97 = 0)""")
register("completeness_digests", lambda s, d: digests.completeness(table(s, d, "orders").where("o_orderkey % 31 <> 0"), "o_orderkey", table(s, d, "orders").where("o_orderkey % 29 <> 0"), "o_orderkey"),
         """SELECT *, (missing_count + unexpected_count) / expected_count AS drift_ratio, 'COMPLETENESS_IMBALANCE' AS issue_type FROM (SELECT count(*) FILTER (WHERE o_orderkey % 29 <> 0) AS expected_count, count(*) FILTER (WHERE o_orderkey % 31 <> 0) AS entity_count,
         count(*) FILTER (WHERE o_orderkey % 29 <> 0 AND o_orderkey % 31 = 0) AS missing_count, count(*) FILTER (WHERE o_orderkey % 29 = 0 AND o_orderkey % 31 <> 0) AS unexpected_count FROM orders)""")


def _keyed(s: SparkSession, d: str) -> tuple[intervals.SliceTable, DataFrame]:
    """Bitmaps of the orders by slice, loaded in two runs, and the orders: every 13th once more, in another slice."""
    rows = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("string").alias("slice"))
    rows = rows.unionByName(rows.where("o_orderkey % 13 = 0").withColumn("slice", F.lit("again")))
    index, slices = intervals.SliceTable(s, _path(s, "bitmaps")), rows.select("slice").distinct()
    digests.update_bitmaps(index, rows, slices.where("slice < '3'"), "o_orderkey", "one", "2024-02-01 00:00:00")
    digests.update_bitmaps(index, rows, slices.where("slice >= '2'"), "o_orderkey", "two", "2024-02-01 00:00:00")
    return index, rows


register("unique_grain_bitmaps", lambda s, d: digests.repeated_keys(*_keyed(s, d), "o_orderkey"), "SELECT o_orderkey, 2::BIGINT AS cnt FROM orders WHERE o_orderkey % 13 = 0")
register("distinct_keys_bitmaps", lambda s, d: digests.distinct_keys(_keyed(s, d)[0]), "SELECT count(*) + count(*) FILTER (WHERE o_orderkey % 13 = 0) AS rows, count(*) AS keys FROM orders")

# ---- outcomes -----------------------------------------------------------------------------------------------

register("check_signal", lambda s, d: outcomes.check_signal(frame(s, d, "results").where("node LIKE 'check:%'").selectExpr("node AS check_name", "status"), frame(s, d, "results").selectExpr("node AS check_name", "severity", "blocking")),
         """SELECT node AS check_name, severity, CASE WHEN status <> 'failed' THEN status WHEN severity IN ('info', 'warning') THEN 'success' ELSE 'failed' END AS signal,
         status = 'failed' AND (blocking OR severity = 'critical') AND severity IN ('error', 'critical') AS blocks, status = 'failed' AND severity = 'critical' AS halts_run FROM results WHERE node LIKE 'check:%'""", "results")
register("check_errors", lambda s, d: outcomes.check_errors(frame(s, d, "results"), "p1", "2024-01-30 12:00:00"),
         """SELECT 'p1' AS pipeline, string_split(node, ':')[2] AS asset, array_to_string(string_split(node, ':')[3:], ':') AS check_name, CASE WHEN status = 'failed' THEN 'error' ELSE 'warning' END AS severity,
         CASE WHEN message = '' THEN node || ' ' || status ELSE message END AS message,
         CASE WHEN message = '' THEN '{"status":"' || status || '"}' ELSE '{"error":"' || message || '","status":"' || status || '"}' END AS details_json, TIMESTAMP '2024-01-30 12:00:00' AS run_at FROM results WHERE node LIKE 'check:%:%' AND status IN ('failed', 'skipped')""", "results")


register("check_error_details", lambda s, d: outcomes.check_errors(frame(s, d, "results").withColumns({"stdout": F.when(F.col("blocking"), "two rows"), "stderr": F.lit(""), "metadata": F.when(F.col("severity") == "error", F.create_map(F.lit("rows"), F.lit("2"), F.lit("status"), F.lit("again")))}), "p1", "2024-01-30 12:00:00").select("asset", "check_name", "details_json"),
         """SELECT string_split(node, ':')[2] AS asset, array_to_string(string_split(node, ':')[3:], ':') AS check_name,
         '{' || CASE WHEN message = '' THEN '' ELSE '"error":"' || message || '",' END || CASE WHEN severity = 'error' THEN '"rows":"2","status":"again"' ELSE '"status":"' || status || '"' END
         || CASE WHEN blocking THEN ',"stdout":"two rows"' ELSE '' END || '}' AS details_json FROM results WHERE node LIKE 'check:%:%' AND status IN ('failed', 'skipped')""", "results")


def _failed_parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_partkey") % 2 == 0, "upstream_failed").otherwise("blocked_by_check:grain").alias("reason"))


register("blocked_assets", lambda s, d: outcomes.blocked_assets(frame(s, d, "edges"), _failed_parts(s, d)),
         """, walk(node, tag, level) AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'upstream_failed' ELSE 'blocked_by_check:grain' END, 0 FROM part WHERE p_size = 7
           UNION SELECT e.child, w.tag, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node)
         , first AS (SELECT node, tag, min(level) AS level FROM walk GROUP BY ALL), seeds AS (SELECT node, tag FROM walk WHERE level = 0)
         SELECT node AS asset, arg_min(tag, {'l': level, 't': tag}) AS reason FROM first WHERE (node, tag) NOT IN (FROM seeds) GROUP BY node""", "edges")



def skipped_query(s: SparkSession, d: str) -> DataFrame:
    """Parts as nodes, each eleventh with a check: some nodes fail, some succeed, checks fail with all severities."""
    edges = frame(s, d, "edges").select(*(F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in ("parent", "child")))
    parts = table(s, d, "part")
    name = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    checks_of = parts.where("p_partkey % 11 = 0").select(name.alias("parent"), F.concat(F.lit("check:"), name, F.lit(":grain")).alias("child"), "p_partkey")
    severity = F.element_at(F.array(*(F.lit(x) for x in ("info", "warning", "error", "critical"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    told = checks_of.select(F.col("child").alias("asset"), F.lit("failed").alias("status"), (F.col("p_partkey") * 13 % 5003).alias("seq"), severity.alias("severity"), (F.col("p_partkey") % 3 == 0).alias("blocking"))
    nodes = parts.where("p_size IN (7, 8)").select(name.alias("asset"), F.when(F.col("p_size") == 7, "failed").otherwise("success").alias("status"), (F.col("p_partkey") * 17 % 5009).alias("seq"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("boolean").alias("blocking"))
    return outcomes.skipped_assets(edges.unionByName(checks_of.select("parent", "child")), nodes.unionByName(told))


register("skipped_assets", skipped_query,
         """, e AS (SELECT 'n' || parent AS parent, 'n' || child AS child FROM edges UNION ALL SELECT 'n' || p_partkey, 'check:n' || p_partkey || ':grain' FROM part WHERE p_partkey % 11 = 0),
         r AS (SELECT 'n' || p_partkey AS asset, p_size = 7 AS bad, p_partkey * 17 % 5009 AS seq, false AS blocks FROM part WHERE p_size IN (7, 8)
               UNION ALL SELECT 'check:n' || p_partkey || ':grain', p_partkey % 4 >= 2, p_partkey * 13 % 5003, p_partkey % 3 = 0 OR p_partkey % 4 = 3 FROM part WHERE p_partkey % 11 = 0),
         seeds AS (SELECT asset AS node, {'q': seq, 's': 0, 'a': asset} AS tag FROM r WHERE bad UNION ALL SELECT e.parent, {'q': seq, 's': 1, 'a': asset} FROM r JOIN e ON e.child = r.asset WHERE bad AND blocks),
         walk(node, tag) AS (SELECT e.child, s.tag FROM seeds s JOIN e ON e.parent = s.node UNION SELECT e.child, w.tag FROM walk w JOIN e ON e.parent = w.node),
         best AS (SELECT node, min(tag) AS tag FROM walk WHERE node NOT IN (SELECT asset FROM r) GROUP BY node)
         SELECT node AS asset, CASE WHEN tag.s = 1 THEN 'skipped: blocked_by_check:' || tag.a ELSE 'skipped: dependency ' || tag.a || ' failed' END AS reason, CASE WHEN tag.s = 1 THEN tag.a END AS blocked_by_check FROM best""", "edges")

# ---- models -------------------------------------------------------------------------------------------------

register("stg_orders", lambda s, d: _double(models.stg_orders(frame(s, d, "raw_orders")), "order_total"),
         "SELECT order_id, customer_id, round(order_total, 2)::DOUBLE AS order_total, created_at, status FROM raw_orders WHERE status <> 'cancelled'", "raw_orders")


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


_SUMMARY = "SELECT customer_id, count(*) AS total_orders, sum(round(order_total, 2))::DOUBLE AS lifetime_spend, min(created_at) AS first_order_at, max(created_at) AS last_order_at FROM raw_orders WHERE status <> 'cancelled' GROUP BY customer_id"
register("int_order_summary", lambda s, d: _double(models.int_order_summary(models.stg_orders(frame(s, d, "raw_orders"))), "lifetime_spend"), _SUMMARY, "raw_orders")
register("entity_customers", lambda s, d: _double(models.entity_customers(models.int_order_summary(models.stg_orders(frame(s, d, "raw_orders"))), "2001-08-02 00:00:00"), "lifetime_spend"),
         f"SELECT *, date_diff('day', last_order_at::DATE, DATE '2001-08-02')::INTEGER AS days_since_last_order, CASE WHEN total_orders >= 10 THEN 'high' WHEN total_orders >= 3 THEN 'medium' ELSE 'low' END AS order_frequency_tier FROM ({_SUMMARY})", "raw_orders")
register("recent_orders", lambda s, d: models.recent_orders(frame(s, d, "raw_orders"), "2001-08-01 00:00:00", 400).select("order_id", "created_at"),
         "SELECT order_id, created_at FROM raw_orders WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY", "raw_orders")
register("run_model", lambda s, d: models.run_model(s, "SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name", {"c": table(s, d, "customer"), "n": table(s, d, "nation")}, {"least": 100}),
         "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name")
register("cast_to_currency", lambda s, d: frame(s, d, "priced").select("l_orderkey", "l_linenumber", cast_to_currency("amount").cast("double").alias("amount")),
         "SELECT l_orderkey, l_linenumber, round(amount, 2)::DOUBLE AS amount FROM priced", "priced")


def sql_function_query(s: SparkSession, d: str) -> DataFrame:
    sql_function(s, "tier_of", {"balance": "double", "least": "double"}, "string", "CASE WHEN $1 >= $2 THEN 'rich' WHEN $1 < 0 THEN 'debt' ELSE 'plain' END")
    return table(s, d, "customer").select("c_custkey", F.expr("tier_of(c_acctbal, 5000D)").alias("tier"))


register("sql_function", sql_function_query, "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' ELSE 'plain' END AS tier FROM customer")
register("clean_events", lambda s, d: models.clean_events(table(s, d, "events").withColumn("ts", F.when(F.col("event_id") % 9 != 0, F.col("ts"))), "ts", f"clean-{uuid.uuid4().hex}")[0].select("event_id", "ts"),
         "SELECT event_id, ts FROM events WHERE event_id % 9 <> 0")


def rename_json_query(s: SparkSession, d: str) -> DataFrame:
    a, b = _path(s, "people"), _path(s, "people")
    table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.json(a)
    return models.rename_json_field(s, a, "name", "full_name", b).select("id", "full_name")


register("rename_json_field", rename_json_query, "SELECT c_custkey AS id, c_name AS full_name FROM customer")
register("test_window", lambda s, d: models.test_window(table(s, d, "events"), "ts", "2w", AS_OF).select("event_id", "ts"),
         "SELECT event_id, ts FROM events WHERE ts::DATE BETWEEN DATE '2024-01-30' - 14 AND DATE '2024-01-30'")

# ---- intervals ----------------------------------------------------------------------------------------------

_CALENDAR = """, steps AS (SELECT asset, unnest(generate_series("start", "end", CASE unit WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END)) AS interval_start, "end", CASE unit WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 DAY END AS step FROM specs WHERE "end" > "start"),
calendar AS (SELECT asset, interval_start, least(interval_start + step, "end") AS interval_end, interval_start + step > "end" AS partial FROM steps WHERE interval_start < "end"),
missing AS (SELECT c.asset, c.interval_start, c.interval_end, s.batch_size, s.lookback FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY interval_start DESC) AS k FROM calendar) c JOIN specs s ON s.asset = c.asset
    WHERE k <= s.lookback OR NOT EXISTS (SELECT 1 FROM state t WHERE t.asset = c.asset AND t.interval_start = c.interval_start AND t.status = 'complete'))
"""


def _missing(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    specs = frame(s, d, "specs")
    return intervals.missing_intervals(intervals.interval_calendar(specs), frame(s, d, "state"), specs), specs


register("interval_calendar", lambda s, d: intervals.interval_calendar(frame(s, d, "specs")), _CALENDAR + "SELECT * FROM calendar", "specs state")
register("missing_intervals", lambda s, d: _missing(s, d)[0], _CALENDAR + "SELECT asset, interval_start, interval_end FROM missing", "specs state")
register("batch_intervals", lambda s, d: intervals.batch_intervals(*_missing(s, d)),
         _CALENDAR + "SELECT asset, interval_start, interval_end FROM missing QUALIFY batch_size <= 0 OR row_number() OVER (PARTITION BY asset ORDER BY interval_start) <= batch_size", "specs state")
register("test_interval_limit", lambda s, d: intervals.test_interval_limit(*_missing(s, d)),
         _CALENDAR + "SELECT asset, interval_start, interval_end FROM missing QUALIFY row_number() OVER (PARTITION BY asset ORDER BY interval_start DESC) <= greatest(3, lookback + 1)", "specs state")
register("interval_plan", lambda s, d: intervals.interval_plan(intervals.interval_calendar(frame(s, d, "specs")), frame(s, d, "state"), frame(s, d, "specs")),
         _CALENDAR + "SELECT s.asset, count(m.interval_start) AS pending FROM specs s LEFT JOIN missing m ON m.asset = s.asset GROUP BY s.asset", "specs state")
register("interval_slice", lambda s, d: intervals.interval_slice(table(s, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-07 00:00:00").select("event_id", "ts"),
         "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
register("assign_interval", lambda s, d: intervals.assign_interval(table(s, d, "events"), "ts", "week", "2024-01-01 00:00:00").select("event_id", "interval_start"),
         "SELECT event_id, TIMESTAMP '2024-01-01' + INTERVAL 7 DAY * CAST(floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7) AS INTEGER) AS interval_start FROM events")


def _sliced(s: SparkSession, d: str) -> intervals.SliceTable:
    """Loads all days under an audit of values, then reloads two thirds of them: one has lost its rows, and no negative value may be published."""
    events, path = table(s, d, "events"), _path(s, "slices")
    days = events.select(F.date_trunc("day", "ts").alias("interval_start")).distinct()
    intervals.load_slices(events, "ts", days, path, run_id="first", at="2024-02-01 00:00:00", backoff=0)
    left = events.where(F.dayofmonth("ts") != 7).withColumn("value", F.when(F.dayofmonth("ts") == 11, -F.col("value")).otherwise(F.col("value")))
    audit = rule_audit({"value_is_not_negative": F.col("value") < 0}, ["event_id"])
    return intervals.load_slices(left, "ts", days.where(F.dayofmonth("interval_start") % 3 != 0), path, run_id="again", at="2024-02-02 00:00:00", audit=audit, stop_at_failure=False)


def incremental_query(s: SparkSession, d: str) -> DataFrame:
    """Nothing may double, stay or vanish, and the failed day keeps what it had."""
    return _sliced(s, d).read().groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


register("incremental_overwrite", incremental_query, "SELECT strftime(ts, '%Y-%m-%d') AS slice, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE day(ts) <> 7 GROUP BY ALL")
register("slice_state", lambda s, d: _sliced(s, d).state().drop("live"),
         """SELECT strftime(ts, '%Y-%m-%d') AS slice, CASE WHEN day(ts) = 11 AND count(*) FILTER (WHERE value > 0) > 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN day(ts) = 7 THEN 0 ELSE count(*) END AS rows,
         CASE WHEN day(ts) % 3 = 0 THEN 'first' ELSE 'again' END AS run_id, CASE WHEN day(ts) % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS started_at,
         CASE WHEN day(ts) % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS completed_at, 1::INTEGER AS attempts,
         CASE WHEN day(ts) = 11 AND count(*) FILTER (WHERE value > 0) > 0 THEN 'value_is_not_negative: ' || count(*) FILTER (WHERE value > 0) END AS error
         FROM events GROUP BY strftime(ts, '%Y-%m-%d'), day(ts)""")
register("interval_state_upsert", lambda s, d: intervals.interval_state_upsert(frame(s, d, "state_log")),
         """, f AS (SELECT asset, interval_start, min(seq) AS first, max(seq) AS last_open FROM state_log WHERE status = 'in_progress' GROUP BY ALL),
         l AS (SELECT s.*, f.last_open FROM state_log s JOIN f ON f.asset = s.asset AND f.interval_start = s.interval_start AND s.seq >= f.first)
         SELECT asset, interval_start, arg_max(status, seq) AS status, arg_max(run_id, seq) AS run_id, max("at") FILTER (WHERE seq = last_open) AS started_at, CASE WHEN arg_max(status, seq) <> 'in_progress' THEN arg_max("at", seq) END AS completed_at FROM l GROUP BY asset, interval_start""", "state_log")
register("invalidate_intervals", lambda s, d: intervals.invalidate_intervals(frame(s, d, "state"), frame(s, d, "specs").where("asset = 'hourly'")).select("asset", "interval_start", "status"),
         "SELECT asset, interval_start, status FROM state WHERE asset <> 'hourly'", "state")
register("recover_orphans", lambda s, d: intervals.recover_orphans(frame(s, d, "state"), "2024-01-20 00:00:00").select("asset", "interval_start", "status"),
         "SELECT asset, interval_start, CASE WHEN status = 'in_progress' AND started_at < TIMESTAMP '2024-01-20' - INTERVAL 2 HOUR THEN 'pending' ELSE status END AS status FROM state", "state")
register("freshness_status", lambda s, d: intervals.freshness_status(frame(s, d, "specs").select("asset", "window"), frame(s, d, "state"), AS_OF),
         f"""SELECT s.asset, t.last_completed, round((epoch_us({NOW}) - epoch_us(t.last_completed)) / 3.6e9, 3) AS age_hours, coalesce(epoch_us({NOW}) - epoch_us(t.last_completed) <= 3.6e9 * CASE "window" WHEN '6h' THEN 6 WHEN '2d' THEN 48 WHEN '9d' THEN 216 ELSE 1 END, false) AS fresh,
         CASE WHEN t.last_completed IS NULL THEN 'no completed interval' WHEN epoch_us({NOW}) - epoch_us(t.last_completed) <= 3.6e9 * CASE "window" WHEN '6h' THEN 6 WHEN '2d' THEN 48 WHEN '9d' THEN 216 ELSE 1 END THEN 'fresh' ELSE 'stale' END AS message
         FROM specs s LEFT JOIN (SELECT asset, max(completed_at) AS last_completed FROM state WHERE status = 'complete' GROUP BY asset) t ON t.asset = s.asset""", "specs state")
