"""Tables of time slices, loaded by write, audit and publish.

A table's folder holds ``data/commit=<id>/slice=<name>/`` (files that are never changed), ``states/<id>`` (small Parquet tables, one row a
slice) and ``versions/<number>`` (files of one line that name a state table). A version becomes visible by one atomic rename that fails where
the number is taken, so of two writers one has to look again; readers follow the newest version and see whole loads only.

A load takes two versions: the first marks its slices in progress, the second publishes what was staged and passed the audit and marks each slice
complete or failed. Both hold the state of all slices and, for each, the commit that is live. A job that dies in between leaves its slices in progress, with what they
held before still readable; a later load of the slices goes on from there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.expressions import moment
from tidewatch.operators.checks import unique_grain
from tidewatch.sources.scratch import renamed

STATE = "slice string, status string, live string, rows bigint, run_id string, started_at timestamp_ntz, completed_at timestamp_ntz, attempts int, error string"


class Conflict(RuntimeError):
    """Another run has taken a slice over."""


def rule_audit(rules: dict[str, Column], grain: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """An audit of staged slices: how many rows of each slice break each rule, and repeated grain values inside a slice.

    All rules are counted in one pass over the stage.
    """

    def audit(staged: DataFrame) -> DataFrame:
        counts = staged.groupBy("slice").agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(rules.values())))
        cells = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(rules)))
        parts = [counts.select("slice", F.explode(cells).alias("r")).select("slice", "r.*")] if rules else []
        if grain:
            twice = unique_grain(staged, ["slice", *grain], None)
            parts.append(twice.groupBy("slice").agg(F.count(F.lit(1)).alias("violations")).select("slice", F.lit("unique_grain").alias("check_name"), "violations"))
        return reduce(DataFrame.unionByName, parts)

    return audit


class SliceTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    # ---- versions

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.conf)

    def version(self) -> int:
        """The newest version; 0: none."""
        fs, at = self._fs(), self._at("versions")
        if not fs.exists(at):
            return 0
        return max([0, *(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())])

    def _told(self, version: int) -> dict:
        stream = self._fs().open(self._at(f"versions/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, told: dict) -> bool:
        """Makes ``told`` that version; False where another writer was first."""
        fs, tmp = self._fs(), self._at(f"versions/_{uuid.uuid4().hex}")
        stream = fs.create(tmp, False)
        stream.write(json.dumps(told).encode())
        stream.close()
        if renamed(self.spark, tmp.toString(), f"{self.path}/versions/{version:012d}"):
            return True
        fs.delete(tmp, False)
        return False

    # ---- reading

    def state(self, version: int | None = None) -> DataFrame:
        """One row a slice: status (in_progress, complete, failed), live commit, rows, run and times, attempts, error."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/states/{self._told(version)['state']}")

    def schema(self) -> StructType | None:
        version = self.version()
        return StructType.fromJson(self._told(version)["schema"]) if version else None

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows with ``slice`` (text). Commits that aren't live are not listed as input."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"no version at {self.path}")
        told = self._told(version)
        schema = StructType.fromJson(told["schema"])
        live = self.state(version).where("live IS NOT NULL").select(F.col("live").alias("commit"), "slice")
        if not self._fs().exists(self._at("data")):
            return self.spark.createDataFrame([], schema).withColumn("slice", F.lit(None).cast("string"))
        files = self.spark.read.schema(StructType([*schema.fields]).add("commit", "string").add("slice", "string")).parquet(f"{self.path}/data")
        commits = [r["commit"] for r in live.select("commit").distinct().collect()]  # one for each load that is still read
        return files.where(F.col("commit").isin(commits)).join(live, ["commit", "slice"]).select(*(F.col(f"`{c}`") for c in schema.names), "slice")

    # ---- loading

    def _change(self, change: Callable[[DataFrame], DataFrame], schema: StructType, tries: int = 20) -> int:
        """Publishes ``change`` of the newest state, looking again where another writer was first."""
        for _ in range(tries):
            version = self.version()
            name = uuid.uuid4().hex
            change(self.state(version)).coalesce(1).write.parquet(f"{self.path}/states/{name}")  # a row a slice
            if self._publish(version + 1, {"state": name, "schema": schema.jsonValue()}):
                return version + 1
        raise Conflict(f"{tries} other versions came first at {self.path}")

    def begin(self, slices: DataFrame, schema: StructType, run_id: str, at) -> int:
        """Marks slices (slice) in progress; what is live stays."""
        opened = slices.select("slice").distinct()

        def change(old: DataFrame) -> DataFrame:
            kept = old.join(opened, "slice", "left_anti")
            new = opened.join(old.select("slice", "live", "rows"), "slice", "left").select(
                "slice", F.lit("in_progress").alias("status"), "live", "rows", F.lit(run_id).alias("run_id"), moment(at).alias("started_at"),
                F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"),
            )
            return kept.unionByName(new)

        return self._change(change, schema)

    def stage(self, rows: DataFrame) -> str:
        """Writes rows (with ``slice``) as a commit that nobody reads yet."""
        commit = uuid.uuid4().hex
        rows.write.partitionBy("slice").parquet(f"{self.path}/data/commit={commit}")
        return commit

    def staged(self, commit: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields]).add("slice", "string")).parquet(f"{self.path}/data/commit={commit}")

    def publish(self, outcome: DataFrame, schema: StructType, run_id: str, at) -> int:
        """outcome: slice, status, live, rows, attempts, error of slices that this run has in progress; a null status forgets that the slice was begun."""

        def change(old: DataFrame) -> DataFrame:
            mine = old.where((F.col("status") == "in_progress") & (F.col("run_id") == run_id))
            lost = outcome.join(mine.select("slice"), "slice", "left_anti").limit(1).collect()
            if lost:
                raise Conflict(f"slice {lost[0]['slice']} was taken over by another run")
            kept = old.join(outcome.select("slice"), "slice", "left_anti")
            new = outcome.join(mine.select("slice", "started_at", F.col("live").alias("was"), F.col("rows").alias("had")), "slice").where("status IS NOT NULL OR was IS NOT NULL")
            done = F.col("status") == "complete"
            new = new.select(
                "slice", F.coalesce("status", F.lit("pending")).alias("status"), F.when(done, F.col("live")).otherwise(F.col("was")).alias("live"),
                F.when(done, F.col("rows")).otherwise(F.col("had")).alias("rows"), F.lit(run_id).alias("run_id"), "started_at", F.when(F.col("status").isNotNull(), moment(at)).alias("completed_at"), "attempts", "error",
            )
            return kept.unionByName(new)

        return self._change(change, schema)

    def load(
        self, rows: DataFrame, slices: DataFrame, run_id: str, at, audit: Callable[[DataFrame], DataFrame] | None = None, attempts: int = 3, backoff: float = 10.0,
        retryable: Callable[[str], bool] = lambda error: False, stop_at_failure: bool = True,
    ) -> DataFrame:
        """Loads ``slices`` (slice) from ``rows`` (with slice) and returns the state.

        Staging is tried up to ``attempts`` times while ``retryable`` says so of the error, waiting ``backoff`` seconds, then twice as long each time; in the end all slices are failed and the error is raised. ``audit``:
        staged rows -> (slice, check_name, violations). Slices with violations are failed and keep what they had; with ``stop_at_failure`` the slices after the first of them are put back as they were, as slices
        are loaded in order of time. A slice without rows is complete and empty.
        """
        schema = StructType([f for f in rows.schema.fields if f.name != "slice"])
        self.begin(slices, schema, run_id, at)
        wanted = slices.select("slice").distinct()
        for attempt in range(1, attempts + 1):
            try:
                commit = self.stage(rows.join(wanted, "slice", "left_semi"))
                break
            except Exception as e:
                error = str(e).split("\n")[0][:2000]
                if attempt == attempts or not retryable(str(e)):
                    self.publish(wanted.select("slice", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("live"), F.lit(None).cast("bigint").alias("rows"), F.lit(attempt).alias("attempts"), F.lit(error).alias("error")), schema, run_id, at)
                    raise
                time.sleep(backoff * 2 ** (attempt - 1))
        staged = self.staged(commit, schema)
        counts = staged.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))  # of file footers and folder names
        outcome = wanted.join(counts, "slice", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))
        failed = F.lit(None).cast("string")
        if audit is not None:
            text = F.concat_ws(": ", "check_name", F.col("violations").cast("string"))
            bad = audit(staged).where("violations > 0").groupBy("slice").agg(F.concat_ws("; ", F.array_sort(F.collect_list(text))).alias("found"))
            outcome, failed = outcome.join(bad, "slice", "left"), F.col("found")
        outcome = outcome.withColumn("error", failed)
        if stop_at_failure and audit is not None:
            first = outcome.where("error IS NOT NULL").agg(F.min("slice").alias("stop"))
            outcome = outcome.crossJoin(first)  # one row
        else:
            outcome = outcome.withColumn("stop", F.lit(None).cast("string"))
        status = F.when(F.col("slice") > F.col("stop"), F.lit(None)).when(F.col("error").isNotNull(), "failed").otherwise("complete")
        outcome = outcome.select("slice", status.alias("status"), F.lit(commit).alias("live"), "rows", F.lit(attempt).alias("attempts"), F.when(status == "failed", F.col("error")).alias("error"))
        # looked at once: a conflict reads the small table again, not the audit
        held = f"{self.path}/states/outcome-{commit}"
        outcome.coalesce(1).write.parquet(held)
        self.publish(self.spark.read.schema(outcome.schema).parquet(held), schema, run_id, at)
        self._fs().delete(self.jvm.Path(held), True)
        return self.state()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes commits, states and versions that the newest ``keep`` versions don't name; returns how many folders and files went.

        Not while a load is on: what it has staged is not named yet.
        """
        fs, newest = self._fs(), self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        states = {self._told(v)["state"] for v in kept}
        live = reduce(DataFrame.union, [self.state(v).select("live") for v in kept]).where("live IS NOT NULL").distinct()
        named = {r["live"] for r in live.collect()}  # one for each load that is still read
        gone = 0
        for folder, spare in (("data", {f"commit={c}" for c in named}), ("states", states), ("versions", {f"{v:012d}" for v in kept})):
            if fs.exists(self._at(folder)):
                for s in fs.listStatus(self._at(folder)):
                    if s.getPath().getName() not in spare:
                        gone += bool(fs.delete(s.getPath(), True))
        return gone
