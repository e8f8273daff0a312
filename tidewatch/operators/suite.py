"""Check suites: what a table's layer implies, with all row-level rules of a table in one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import moment
from tidewatch.operators import checks


@dataclass(frozen=True)
class Completeness:
    """Where an entity's keys come from: source keys, less exclusions, plus additions, each (frame, column)."""

    source: DataFrame
    pk: str
    exclusions: tuple[tuple[DataFrame, str], ...] = ()
    additions: tuple[tuple[DataFrame, str], ...] = ()
    tolerance: float = 0.01


@dataclass(frozen=True)
class TableSpec:
    """What is known of a table. ``foreign_keys``: column -> (parent frame, parent column, nullable).

    ``blocking``: whether the layer's default checks block; ``fan_out`` and ``min_retention`` hold for intermediate tables.
    """

    name: str
    layer: str
    grain: tuple[str, ...] = ()
    created: str | None = None
    updated: str | None = None
    not_null: tuple[str, ...] = ()
    accepted: dict = field(default_factory=dict)
    foreign_keys: dict = field(default_factory=dict)
    email: tuple[str, ...] = ()
    phone: tuple[str, ...] = ()
    currency: tuple[str, ...] = ()
    default_checks: bool = True
    since: str = "2024-01-01"
    blocking: bool = False
    fan_out: bool = True
    min_retention: float = 0.5
    completeness: tuple[Completeness, ...] = ()


@dataclass(frozen=True)
class SourceSpec:
    """What is known of a source. ``tables``: name -> frame, or None for a missing table; ``micros``: the column of the
    last change. Keys and expected columns are checked if the source has one table, freshness on its first."""

    name: str
    tables: dict[str, DataFrame | None]
    primary_key: str | None = None
    fresh_minutes: int | None = None
    micros: str | None = None
    expected_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    """A named rule: ``rows`` gives violations; ``predicate`` is set if a row violates on its own."""

    name: str
    rows: DataFrame
    predicate: Column | None = None
    severity: str = "error"
    blocking: bool = False


def check_suite(spec: TableSpec, df: DataFrame, as_of, upstream: DataFrame | None = None, source: tuple[DataFrame, str] | None = None) -> list[Check]:
    """The checks that a table's layer and declarations imply."""
    grain, out, now = list(spec.grain), [], moment(as_of)

    def row(name: str, bad: Column, **more) -> None:
        out.append(Check(name, df.where(bad), bad, **more))

    def default(name: str, rows: DataFrame) -> None:
        out.append(Check(name, rows, blocking=spec.blocking))

    if spec.default_checks and spec.layer and grain:
        if spec.layer != "report":
            default("unique_grain", checks.unique_grain(df, grain, None))
        if spec.layer == "staging":
            missing = F.lit(False)
            for g in grain:
                missing = missing | F.col(g).isNull()
            row("not_null_grain", missing, blocking=spec.blocking)
            default("not_empty", checks.not_empty(df))
            if spec.created and spec.updated:
                row("no_future_timestamps", F.coalesce((F.col(spec.created) > now) | (F.col(spec.updated) > now), F.lit(False)), blocking=spec.blocking)
                row("updated_at_gte_created_at", F.coalesce((F.col(spec.updated) < F.col(spec.created)) & (F.col(spec.created) > moment(spec.since)), F.lit(False)), blocking=spec.blocking)
                if source:
                    default("source_completeness", checks.source_completeness(source[0], source[1] or grain[0], df, grain[0], spec.created, as_of, None))
        if spec.layer == "intermediate" and upstream is not None:
            if spec.fan_out:
                default("fan_out", checks.fan_out(df, upstream))
            default("row_retention", checks.row_retention(df, upstream, spec.min_retention))
        if spec.layer == "report":
            default("row_count", checks.row_count_nonzero(df))
    for c in spec.not_null:
        row(f"not_null:{c}", F.col(c).isNull(), blocking=True)
    for c, values in spec.accepted.items():
        row(f"accepted_values:{c}", F.col(c).isNull() | ~F.col(c).isin(list(values)), blocking=True)
    for c, (parent, parent_column, nullable) in spec.foreign_keys.items():
        if not nullable:
            row(f"fk_not_null:{c}", F.col(c).isNull())
        out.append(Check(f"fk:{c}", checks.fk_integrity(df, grain, c, parent, parent_column, None)))
    for i, x in enumerate(spec.completeness):
        out.append(Check("completeness" if not i else f"completeness:{i}", checks.completeness(df, grain[0], x.source, x.pk, list(x.exclusions), list(x.additions), x.tolerance)))
    for c in spec.email:
        row(f"email:{c}", F.coalesce(F.col(c) != F.lower(F.trim(c)), F.lit(False)))
    for c in spec.phone:
        row(f"phone:{c}", F.coalesce(~F.col(c).rlike(r"^1-[0-9]{3}-[0-9]{3}-[0-9]{4}\z"), F.lit(False)))
    for c in spec.currency:
        row(f"currency:{c}", F.coalesce(F.col(c) != F.round(c, 2), F.lit(False)))
    return out


def source_suite(spec: SourceSpec, as_of) -> list[Check]:
    """The checks that a source's declarations imply: every table is there and not empty; freshness of the first
    table; key and columns of an only table. A missing table fails its first check alone."""
    out = [Check(f"source:{spec.name}:{name}:exists_not_empty", checks.source_not_empty(df)) for name, df in spec.tables.items()]
    first, only = next(iter(spec.tables.values()), None), len(spec.tables) == 1
    if first is None:
        return out
    if spec.fresh_minutes is not None and spec.micros:
        out.append(Check(f"source:{spec.name}:freshness", checks.source_freshness(first, spec.micros, spec.fresh_minutes, as_of)))
    if only and spec.primary_key:
        out.append(Check(f"source:{spec.name}:pk_not_null", checks.source_pk_not_null(first, spec.primary_key)))
        out.append(Check(f"source:{spec.name}:pk_unique", checks.source_pk_unique(first, spec.primary_key, None)))
    if only and spec.expected_columns:
        absent = [c for c in spec.expected_columns if c not in first.columns]  # a schema question: no rows are read
        rows = first.sparkSession.createDataFrame([(spec.name, c, "COLUMN_MISSING") for c in absent], "table_name string, column_name string, issue_type string")
        out.append(Check(f"source:{spec.name}:expected_columns", rows))
    return out


def check_summary(df: DataFrame, suite: list[Check]) -> DataFrame:
    """check_name, violations, status of every check.

    Row-level rules are counted together in one scan of ``df``; only key checks have plans of their own.
    """
    fused = [c for c in suite if c.predicate is not None]
    parts = []
    if fused:
        counts = df.agg(*(F.count_if(c.predicate).alias(f"c{i}") for i, c in enumerate(fused)))
        pairs = F.explode(F.array(*(F.struct(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(fused)))).alias("r")
        parts.append(counts.select(pairs).select("r.*"))
    for c in suite:
        if c.predicate is None:
            parts.append(c.rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("violations") == 0, "passed").otherwise("failed"))


def check_samples(suite: list[Check], failed: set[str], limit: int = 100) -> DataFrame:
    """check_name and a row as JSON, at most ``limit`` rows for each failed check; passing checks are not read again."""
    out = None
    for c in suite:
        if c.name in failed:
            rows = c.rows.limit(limit).select(F.lit(c.name).alias("check_name"), F.to_json(F.struct("*")).alias("sample"))
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else suite[0].rows.limit(0).select(F.lit("").alias("check_name"), F.lit("").alias("sample"))
