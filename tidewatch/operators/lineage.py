"""Lineage as an edge table (parent, child), kept for many pipelines.

Closures and peeling are loops of joins over shrinking frontiers. Each round is written to the folder that the
cluster shares (see ``sources.scratch``), so plans stay short and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import written


def lineage_edges(assets: DataFrame) -> DataFrame:
    """parent, child, parent_layer, child_layer from assets (asset, layer, depends_on); checks and sources are no targets."""
    child = assets.where(~F.col("asset").startswith("check:") & ~F.col("asset").startswith("source:"))
    edges = child.select(F.explode("depends_on").alias("parent"), F.col("asset").alias("child"), F.col("layer").alias("child_layer"))
    return edges.join(assets.select(F.col("asset").alias("parent"), F.col("layer").alias("parent_layer")), "parent", "left").select("parent", "child", "parent_layer", "child_layer")


def expand_outputs(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Edges with every multi-output node (asset, output) replaced by its outputs."""
    up = outputs.select(F.col("asset").alias("parent"), F.col("output").alias("parent_output"))
    down = outputs.select(F.col("asset").alias("child"), F.col("output").alias("child_output"))
    wide = edges.join(up, "parent", "left").join(down, "child", "left")
    return wide.select(F.coalesce("parent_output", "parent").alias("parent"), F.coalesce("child_output", "child").alias("child")).distinct()


def _closure(edges: DataFrame, seeds: DataFrame, include_seeds: bool, carry: str | None, forward: bool) -> DataFrame:
    step = written(edges.select(F.col("parent" if forward else "child").alias("node"), F.col("child" if forward else "parent").alias("next")).distinct(), "closure")
    keys = ["node", *([carry] if carry else [])]
    seed = written(seeds.select(*keys).distinct().withColumn("level", F.lit(0)), "closure")
    visited, frontier, level = seed, seed, 0
    while True:
        level += 1
        reached = frontier.select(*keys).join(step, "node").select(F.col("next").alias("node"), *keys[1:]).distinct()
        frontier = written(reached.join(visited.select(*keys), keys, "left_anti").withColumn("level", F.lit(level)), "closure")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % 8 == 0:
            visited = written(visited, "closure")
    if include_seeds:
        return visited
    return visited.where("level > 0")


def descendants(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, carry: str | None = None) -> DataFrame:
    """node (and ``carry``), level: all that depends on the seeds (node); cycles end by themselves."""
    return _closure(edges, seeds, include_seeds, carry, True)


def ancestors(edges: DataFrame, seeds: DataFrame, include_seeds: bool = False, carry: str | None = None) -> DataFrame:
    """node (and ``carry``), level: all that the seeds depend on."""
    return _closure(edges, seeds, include_seeds, carry, False)


def rerun_set(events: DataFrame, edges: DataFrame, run_id) -> DataFrame:
    """asset, kind: failed assets of a run and all below them; failed names that no edge knows are ``missing``."""
    failed = events.where((F.col("run_id") == run_id) & F.col("event_type").isin("asset_failed", "node_failed")).select(F.col("asset").alias("node")).distinct()
    known = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    here = failed.join(known, "node", "left_semi")
    below = descendants(edges, here, include_seeds=True).groupBy("node").agg(F.min("level").alias("level"))
    found = below.select(F.col("node").alias("asset"), F.when(F.col("level") == 0, "failed").otherwise("downstream").alias("kind"))
    return found.unionByName(failed.join(known, "node", "left_anti").select(F.col("node").alias("asset"), F.lit("missing").alias("kind")))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def _peel(edges: DataFrame, nodes: DataFrame, into: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Takes nodes without edges into them away, round by round: (peeled with level, nodes left, edges left).

    ``into``: child (from the roots down) or parent (from the leaves up).
    """
    away = "parent" if into == "child" else "child"
    edges = written(edges.select("parent", "child").distinct(), "peel")
    need = edges.groupBy(F.col(into).alias("node")).agg(F.count(F.lit(1)).alias("need"))
    need = written(nodes.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0).cast("bigint")).alias("need")), "peel")
    free = written(need.where("need = 0").select("node", F.lit(0).alias("level")), "peel")
    peeled, level, met = free, 0, None

    def freed(of: DataFrame, before: DataFrame | None, at: int) -> DataFrame:
        """The nodes that lose an edge as ``of`` go: all that they have lost so far (met), and ``at`` as level if that is all they had."""
        lost = edges.join(of.select(F.col("node").alias(away)), away).groupBy(F.col(into).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        if before is not None:
            known = before.join(lost.select("node"), "node", "left_semi").groupBy("node").agg(F.max("met").alias("m"))
            lost = lost.join(known, "node", "left").select("node", (F.col("n") + F.coalesce("m", F.lit(0).cast("bigint"))).alias("n"))
        return lost.join(need, "node").select("node", F.col("n").alias("met"), F.when(F.col("n") == F.col("need"), F.lit(at)).alias("level"))

    while not free.isEmpty():
        # two levels a job; a job writes the nodes that lose an edge and their counts, not the graph
        one = freed(free, met, level + 1)
        all_met = one.select("node", "met") if met is None else met.unionByName(one.select("node", "met"))
        two = freed(one.where("level IS NOT NULL"), all_met, level + 2)
        step = written(one.unionByName(two), "peel")
        level += 2
        peeled = peeled.unionByName(step.where("level IS NOT NULL").select("node", "level"))
        met = step.select("node", "met") if met is None else met.unionByName(step.select("node", "met"))
        free = step.where(F.col("level") == level)
        if level % 16 == 0:
            peeled, met = written(peeled, "peel"), written(met.groupBy("node").agg(F.max("met").alias("met")), "peel")
    left = need.select("node").join(peeled.select("node"), "node", "left_anti")
    return peeled, left, edges.join(peeled.select(F.col("node").alias(away)), away, "left_anti").select("parent", "child")


def topo_levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest path from a root; nodes on or below a cycle have none and are absent."""
    return _peel(edges, _nodes(edges), "child")[0]


def find_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, or between cycles; none if the graph is acyclic."""
    _, nodes, rest = _peel(edges, _nodes(edges), "child")
    return _peel(rest, nodes, "parent")[1]


#: Order of the layers; an edge may not go down.
LAYERS = {"source": 0, "staging": 1, "intermediate": 2, "entity": 3, "analytics": 3, "report": 4}


def layer_violations(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges whose child is of a lower layer than its parent."""
    rank = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    own = assets.select("asset", F.col("layer"), rank[F.col("layer")].alias("rank"))
    both = edges.join(own.toDF("parent", "parent_layer", "pr"), "parent").join(own.toDF("child", "child_layer", "cr"), "child")
    return both.where("cr < pr").select("parent", "child", "parent_layer", "child_layer")


def ref_mismatch(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Dependencies (asset, dependency) used but not declared, or declared but not used by an asset that uses any."""
    d = declared.where(~F.col("dependency").startswith("source:")).select("asset", "dependency").distinct()
    u = used.where(~F.col("dependency").startswith("source:")).select("asset", "dependency").distinct()
    undeclared = u.join(d, ["asset", "dependency"], "left_anti").withColumn("issue_type", F.lit("UNDECLARED"))
    unused = d.join(u, ["asset", "dependency"], "left_anti").join(used.select("asset").distinct(), "asset", "left_semi").withColumn("issue_type", F.lit("UNUSED"))
    return undeclared.unionByName(unused)


def missing_upstreams(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """node, issue_type: parents that don't exist, and names that occur twice."""
    missing = edges.select(F.col("parent").alias("node")).distinct().join(assets.select(F.col("asset").alias("node")), "node", "left_anti")
    twice = assets.groupBy(F.col("asset").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return missing.withColumn("issue_type", F.lit("MISSING_UPSTREAM")).unionByName(twice.withColumn("issue_type", F.lit("DUPLICATE_NODE")))
