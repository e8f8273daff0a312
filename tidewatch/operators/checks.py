"""Data-quality checks: each returns the rows that violate a rule; no rows means that it passes.

``limit`` bounds the sample (None: all); before a limit rows are ordered by the grain, so samples repeat.
Row-level checks are plain filters, so Spark prunes columns and pushes predicates into the scan. Key checks
combine on the map side before they shuffle. ``as_of`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment, one_row, ratio


def _sample(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def unique_grain(df: DataFrame, grain: list[str], limit: int | None = 10) -> DataFrame:
    """Grain values that occur more than once, with ``cnt``; nulls group together."""
    return _sample(df.groupBy(*grain).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"), grain, limit)


def not_null_grain(df: DataFrame, grain: list[str], limit: int | None = 10) -> DataFrame:
    """Whole rows with a null in the grain."""
    missing = F.lit(False)
    for g in grain:
        missing = missing | F.col(g).isNull()
    return _sample(df.where(missing), df.columns, limit)


def not_empty(df: DataFrame) -> DataFrame:
    """EMPTY_TABLE if there is no row; reads one row at most."""
    one = df.sparkSession.range(1).select(F.lit("EMPTY_TABLE").alias("issue_type"), F.lit(0).cast("bigint").alias("row_count"), F.lit(1).alias("__k"))
    return one.join(df.limit(1).select(F.lit(1).alias("__k")), "__k", "left_anti").drop("__k")


def row_count_nonzero(df: DataFrame) -> DataFrame:
    return one_row(df, F.count(F.lit(1)).alias("row_count")).where("row_count = 0").select(F.lit("empty").alias("issue_type"), "row_count")


def no_future_timestamps(df: DataFrame, grain: list[str], created: str, updated: str, as_of, limit: int | None = 10) -> DataFrame:
    now = moment(as_of)
    issue = F.when(F.col(created) > now, "FUTURE_CREATED_AT").when(F.col(updated) > now, "FUTURE_UPDATED_AT")
    return _sample(df.select(*grain, created, updated, issue.alias("issue_type")).where("issue_type IS NOT NULL"), grain, limit)


def updated_gte_created(df: DataFrame, grain: list[str], created: str, updated: str, since, limit: int | None = 10) -> DataFrame:
    bad = df.where((F.col(updated) < F.col(created)) & (F.col(created) > moment(since)))
    return _sample(bad.select(*grain, created, updated, F.lit("UPDATED_BEFORE_CREATED").alias("issue_type")), grain, limit)


def source_completeness(src: DataFrame, src_pk: str, stg: DataFrame, grain: str, created: str, as_of, limit: int | None = 10) -> DataFrame:
    """Keys of before today that only one side has. Null keys never match."""
    today = F.date_trunc("day", moment(as_of))
    a = src.where(F.col(created) < today).select(F.col(src_pk).alias("pk")).distinct()
    b = stg.where(F.col(created) < today).select(F.col(grain).alias("pk")).distinct()
    missing = a.join(b, "pk", "left_anti").select("pk", F.lit("MISSING_FROM_STAGING").alias("issue_type"))
    return _sample(missing.unionByName(b.join(a, "pk", "left_anti").select("pk", F.lit("MISSING_FROM_SOURCE").alias("issue_type"))), ["pk"], limit)


def _two_counts(df: DataFrame, upstream: DataFrame) -> DataFrame:
    return one_row(df, F.count(F.lit(1)).alias("table_row_count")).crossJoin(one_row(upstream, F.count(F.lit(1)).alias("upstream_row_count")))


def fan_out(df: DataFrame, upstream: DataFrame) -> DataFrame:
    """One row if the table has more rows than its upstream."""
    return _two_counts(df, upstream).where("table_row_count > upstream_row_count").withColumn("issue_type", F.lit("FAN_OUT_DETECTED"))


def row_retention(df: DataFrame, upstream: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """One row if too few rows are left of the upstream; an empty upstream passes."""
    both = _two_counts(df, upstream).withColumn("retention_ratio", ratio(F.col("table_row_count"), F.col("upstream_row_count")))
    return both.where(F.col("retention_ratio") < min_ratio).withColumn("issue_type", F.lit("SUSPICIOUS_ROW_LOSS"))


def contract_pk(df: DataFrame, pk: list[str], limit: int | None = 10) -> DataFrame:
    found = unique_grain(df, pk, None).withColumnRenamed("cnt", "duplicate_count").withColumn("issue_type", F.lit("PK_NOT_UNIQUE"))
    return _sample(found, pk, limit)


def contract_not_null(df: DataFrame, column: str, grain: list[str], limit: int | None = 10) -> DataFrame:
    return _sample(df.where(F.col(column).isNull()).select(*grain, F.lit(column).alias("column_name"), F.lit("NULL_VALUE").alias("issue_type")), grain, limit)


def contract_accepted_values(df: DataFrame, column: str, values: list, grain: list[str], limit: int | None = 10) -> DataFrame:
    """Values that are not in the list, or null."""
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(values))
    return _sample(bad.select(*grain, F.col(column).cast("string").alias("value"), F.lit("UNACCEPTED_VALUE").alias("issue_type")), grain, limit)


def fk_not_null(df: DataFrame, grain: list[str], fk: str, limit: int | None = 10) -> DataFrame:
    return _sample(df.where(F.col(fk).isNull()).select(*grain, F.lit(fk).alias("fk_column"), F.lit("FK_IS_NULL").alias("issue_type")), grain, limit)


def fk_integrity(child: DataFrame, grain: list[str], fk: str, parent: DataFrame, parent_column: str, limit: int | None = 10) -> DataFrame:
    """Children whose key is set but has no parent. Spark picks broadcast or shuffle by size."""
    keys = parent.select(F.col(parent_column).alias(fk)).distinct()
    bad = child.where(F.col(fk).isNotNull()).select(*dict.fromkeys([*grain, fk])).join(keys, fk, "left_anti")
    return _sample(bad.select(*grain, F.col(fk).alias("fk_value"), F.lit("ORPHAN_FK").alias("issue_type")), grain, limit)


def completeness(entity: DataFrame, grain: str, source: DataFrame, pk: str, exclusions: list[tuple[DataFrame, str]] = (), additions: list[tuple[DataFrame, str]] = (), tolerance: float = 0.01) -> DataFrame:
    """Expected keys (source, without exclusions, with additions) against the entity's keys; one row if drift exceeds the tolerance.

    Missing and unexpected keys follow NOT IN: a null on the right makes the count 0, a null on the left never
    counts. They are plain anti joins on keys, so large sides are not broadcast.
    """
    expected = source.select(F.col(pk).alias("k")).distinct()
    for df, c in exclusions:
        expected = expected.subtract(df.select(F.col(c).alias("k")).distinct())
    for df, c in additions:
        expected = expected.union(df.select(F.col(c).alias("k"))).distinct()
    actual = entity.select(F.col(grain).alias("k")).distinct()

    def not_in(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        found = one_row(left.where("k IS NOT NULL").join(right.where("k IS NOT NULL"), "k", "left_anti"), F.count(F.lit(1)).alias("n"))
        sides = one_row(left, F.count_if(F.col("k").isNull()).alias("left_nulls")).crossJoin(one_row(right, F.count(F.lit(1)).alias("size"), F.count_if(F.col("k").isNull()).alias("nulls")))
        value = F.when(F.col("nulls") > 0, F.lit(0)).when(F.col("size") == 0, F.col("n") + F.col("left_nulls")).otherwise(F.col("n"))
        return found.crossJoin(sides).select(value.cast("bigint").alias(name))

    counts = one_row(expected, F.count(F.lit(1)).alias("expected_count")).crossJoin(one_row(actual, F.count(F.lit(1)).alias("entity_count")))
    counts = counts.crossJoin(not_in(expected, actual, "missing_count")).crossJoin(not_in(actual, expected, "unexpected_count"))
    drift = counts.withColumn("drift_ratio", ratio(F.col("missing_count") + F.col("unexpected_count"), F.col("expected_count")))
    return drift.where(F.col("drift_ratio") > tolerance).withColumn("issue_type", F.lit("COMPLETENESS_IMBALANCE"))


def _standard(df: DataFrame, grain: list[str], column: str, bad: Column, issue: str, limit: int | None) -> DataFrame:
    rows = df.where(F.col(column).isNotNull() & bad).select(*grain, F.col(column).alias("value"), F.lit(issue).alias("issue_type"))
    return _sample(rows, grain, limit)


def standard_email(df: DataFrame, column: str, grain: list[str], limit: int | None = 10) -> DataFrame:
    """Not lower case, or with spaces around."""
    return _standard(df, grain, column, F.col(column) != F.lower(F.trim(column)), "EMAIL_NOT_NORMALIZED", limit)


def standard_phone(df: DataFrame, column: str, grain: list[str], limit: int | None = 10) -> DataFrame:
    return _standard(df, grain, column, ~F.col(column).rlike(r"^1-[0-9]{3}-[0-9]{3}-[0-9]{4}\z"), "PHONE_FORMAT_INVALID", limit)


def standard_currency(df: DataFrame, column: str, grain: list[str], limit: int | None = 10) -> DataFrame:
    return _standard(df, grain, column, F.col(column) != F.round(column, 2), "CURRENCY_NOT_ROUNDED", limit)


def source_not_empty(df: DataFrame | None) -> DataFrame:
    """EMPTY_OR_MISSING; pass None through ``table_or_none`` for a table that doesn't exist."""
    if df is None:
        spark = SparkSession.getActiveSession()
        return spark.range(1).select(F.lit("EMPTY_OR_MISSING").alias("issue_type"), F.lit(0).cast("bigint").alias("row_count"))
    return not_empty(df).withColumn("issue_type", F.lit("EMPTY_OR_MISSING"))


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def source_freshness(df: DataFrame, micros: str, minutes: int, as_of) -> DataFrame:
    """One row if the newest change is older than ``minutes``; an empty table passes."""
    newest = one_row(df, F.max(micros).alias("latest_micros"))
    age = F.floor((F.unix_micros(moment(as_of).cast("timestamp")) - F.col("latest_micros")) / F.lit(60_000_000)).cast("bigint")
    return newest.withColumn("staleness_minutes", age).where(F.col("staleness_minutes") > minutes).withColumn("issue_type", F.lit("STALE_SOURCE"))


def source_pk_not_null(df: DataFrame, pk: str) -> DataFrame:
    return one_row(df, F.count_if(F.col(pk).isNull()).alias("null_count")).where("null_count > 0").withColumn("issue_type", F.lit("NULL_PK"))


def source_pk_unique(df: DataFrame, pk: str, limit: int | None = 10) -> DataFrame:
    return _sample(unique_grain(df, [pk], None).withColumnRenamed("cnt", "dupe_count"), [pk], limit)


def expected_columns(expectations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Expected (table_name, column_name) that the catalogue lacks; names are case-sensitive."""
    return expectations.join(catalog.select("table_name", "column_name").distinct(), ["table_name", "column_name"], "left_anti").withColumn("issue_type", F.lit("COLUMN_MISSING"))


def partition_layout(spec: DataFrame, layout: DataFrame) -> DataFrame:
    """One row a mismatched field (partition_column, partition_type, clustering) of each table.

    Both frames have table_name and those fields; types compare without case, cluster lists in order.
    """
    fields = ["partition_column", "partition_type", "clustering"]
    both = spec.select("table_name", *(F.col(c).alias(f"e_{c}") for c in fields)).join(layout.select("table_name", *(F.col(c).alias(f"a_{c}") for c in fields)), "table_name", "full_outer")
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"e_{c}").alias("expected"), F.col(f"a_{c}").alias("actual")) for c in fields))).alias("r")
    same = F.when(F.col("field") == "partition_type", F.upper("expected").eqNullSafe(F.upper("actual"))).otherwise(F.col("expected").eqNullSafe(F.col("actual")))
    return both.select("table_name", rows).select("table_name", "r.*").where(~same)


def schema_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Changes of columns (table_name, column_name, data_type, ordinal): removed, added, type_changed."""
    both = prev.select("table_name", "column_name", F.col("data_type").alias("old_type"), F.lit(True).alias("p")).join(cur.select("table_name", "column_name", F.col("data_type").alias("new_type"), F.lit(True).alias("c")), ["table_name", "column_name"], "full_outer")
    kind = F.when(F.col("c").isNull(), "column_removed").when(F.col("p").isNull(), "column_added").when(F.col("old_type") != F.col("new_type"), "type_changed")
    return both.select("table_name", "column_name", kind.alias("change"), "old_type", "new_type").where("change IS NOT NULL")


def schema_history(catalog: DataFrame, response: str = "warn") -> DataFrame:
    """Changes between each run's columns and those of the run before, for every table; the first run has none.

    ``catalog``: run_seq, table_name, column_name, data_type. ``response``: warn, error or ignore.
    """
    severity = {"warn": "warning", "error": "error", "ignore": "info"}[response]
    runs = catalog.select("table_name", "run_seq").distinct()
    from pyspark.sql import Window

    order = Window.partitionBy("table_name").orderBy("run_seq")
    steps = runs.withColumn("prev_seq", F.lag("run_seq").over(order)).where("prev_seq IS NOT NULL")
    now = catalog.join(steps, ["table_name", "run_seq"]).select("table_name", "run_seq", "column_name", F.col("data_type").alias("new_type"), F.lit(True).alias("c"))
    before = catalog.withColumnRenamed("run_seq", "prev_seq").join(steps, ["table_name", "prev_seq"]).select("table_name", "run_seq", "column_name", F.col("data_type").alias("old_type"), F.lit(True).alias("p"))
    both = before.join(now, ["table_name", "run_seq", "column_name"], "full_outer")
    kind = F.when(F.col("c").isNull(), "column_removed").when(F.col("p").isNull(), "column_added").when(F.col("old_type") != F.col("new_type"), "type_changed")
    return both.select("table_name", "run_seq", "column_name", kind.alias("change"), "old_type", "new_type", F.lit(severity).alias("severity")).where("change IS NOT NULL")
