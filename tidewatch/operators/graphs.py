"""Structure of an edge table (parent, child): strongly connected components, cycles, and an index of what reaches what.

Rounds are written to the folder that the cluster shares, as in ``lineage``; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.lineage import _nodes, _peel
from tidewatch.sources.scratch import written


def _greatest_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, color: the greatest node that reaches each node, itself included.

    A color is a node that has a color itself, which reaches as far: colors are looked up in each round, so rounds grow with the logarithm of
    the longest path.
    """
    edges = written(edges.select("parent", "child"), "colors")
    now = written(nodes.select("node", F.col("node").alias("color")), "colors")
    while True:
        met = edges.join(now.select(F.col("node").alias("parent"), "color"), "parent").groupBy(F.col("child").alias("node")).agg(F.max("color").alias("met"))
        new = now.join(met, "node", "left").select("node", F.col("color").alias("was"), F.greatest("color", F.coalesce("met", "color")).alias("color"))
        far = now.select(F.col("node").alias("color"), F.col("color").alias("far"))
        new = written(new.join(far, "color").select("node", F.greatest("color", "far").alias("color"), (F.greatest("color", "far") != F.col("was")).alias("moved")), "colors")
        if new.where("moved").isEmpty():
            return new.select("node", "color")
        now = new.select("node", "color")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), size of all nodes on a cycle; nodes between cycles are not among them.

    Nodes without edges in or out are trimmed. What is left is colored by the greatest node that reaches each node; those nodes of a color that reach
    the color's own node in turn are a component. Components leave, edges between colors can't be on a cycle, and the rest goes on.
    """
    edges = written(edges.select("parent", "child").distinct(), "strong")
    loops = edges.where("parent = child").select(F.col("parent").alias("node"), F.lit(True).alias("loop"))
    found = loops.select("node", F.col("node").alias("color"))
    edges = edges.where("parent <> child")
    while not edges.isEmpty():
        _, nodes, rest = _peel(edges, _nodes(edges), "child")
        _, nodes, rest = _peel(rest, nodes, "parent")
        if nodes.isEmpty():
            break
        colors = _greatest_source(rest, nodes)
        ends = rest.join(colors.toDF("parent", "p"), "parent").join(colors.toDF("child", "c"), "child")
        within = written(ends.where("p = c").select("parent", "child"), "strong")
        back = _greatest_source(within.toDF("child", "parent"), nodes)
        closed = written(colors.join(back.toDF("node", "back"), "node").where("color = back").select("node", "color"), "strong")
        found = found.unionByName(closed)
        away = closed.select("node")
        edges = written(within.join(away.toDF("parent"), "parent", "left_anti").join(away.toDF("child"), "child", "left_anti"), "strong")
    # a node with an edge to itself may be in a larger component; alone and without one it is on no cycle
    found = found.groupBy("node").agg(F.max("color").alias("color")).join(loops, "node", "left")
    sizes = found.groupBy("color").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "color").where(F.coalesce("loop", F.col("size") > 1)).select("node", "component", "size")


def cycle_paths(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """component, size, path: a shortest cycle through the smallest node of each component, that node first and last.

    Of several the least path counts. Rounds grow with the longest of these cycles; a round holds one path for each node reached last.
    """
    components = written(strong_components(edges) if components is None else components, "cycles")
    of = components.select("node", "component")
    within = edges.select("parent", "child").distinct().join(of.toDF("parent", "component"), "parent").join(of.toDF("child", "c2"), "child").where("component = c2")
    within = written(within.select("component", "parent", "child"), "cycles")
    frontier = components.where("node = component").select("component", "node", F.array("node").alias("path"))
    seen, found, rounds = None, None, 0
    while True:
        rounds += 1
        step = frontier.withColumnRenamed("node", "parent").join(within, ["component", "parent"]).groupBy("component", F.col("child").alias("node")).agg(F.min("path").alias("path"))
        step = step.withColumn("path", F.concat("path", F.array("node")))
        if seen is not None:
            step = step.join(seen, ["component", "node"], "left_anti")
        step = written(step, "cycles")
        closed = step.where("node = component").select("component", "path")
        found = closed if found is None else found.unionByName(closed)
        seen = step.select("component", "node") if seen is None else seen.unionByName(step.select("component", "node"))
        # components whose cycle is closed are done
        frontier = step.join(closed.select("component"), "component", "left_anti")
        if frontier.isEmpty():
            break
        if rounds % 8 == 0:
            seen, found = written(seen, "cycles"), written(found, "cycles")
    return components.select("component", "size").distinct().join(found, "component")


class Reachability:
    """All pairs (source, node) with the least number of edges between them, for many questions about one graph.

    Built by doubling: a way of up to 2k edges has a middle at exactly k edges from its source, so the pairs of k edges are joined with all pairs so far.
    ``rounds`` is the logarithm of the longest least way. The index has a row for each pair, so it suits lineage graphs, in which a node has few ancestors next
    to all nodes; ``lineage.descendants`` answers single questions without it.
    """

    def __init__(self, pairs: DataFrame, rounds: int) -> None:
        self.pairs, self.rounds = pairs, rounds

    @classmethod
    def build(cls, edges: DataFrame) -> Reachability:
        pairs = written(edges.select(F.col("parent").alias("source"), F.col("child").alias("node")).where("source <> node").distinct().withColumn("level", F.lit(1)), "reach")
        reach, rounds = 1, 0
        while True:
            rounds += 1
            far = pairs.where(F.col("level") == reach).select("source", F.col("node").alias("middle"))
            on = pairs.select(F.col("source").alias("middle"), "node", (F.col("level") + reach).alias("level"))
            new = far.join(on, "middle").where("source <> node").groupBy("source", "node").agg(F.min("level").alias("level"))
            new = written(new.join(pairs.select("source", "node"), ["source", "node"], "left_anti"), "reach")
            if new.isEmpty():
                return cls(pairs, rounds)
            pairs, reach = pairs.unionByName(new), 2 * reach

    def _closure(self, seeds: DataFrame, start: str, end: str, include_seeds: bool) -> DataFrame:
        keys = [c for c in seeds.columns if c != "node"]
        seed = seeds.distinct()
        met = seed.withColumnRenamed("node", start).join(self.pairs, start).groupBy(F.col(end).alias("node"), *keys).agg(F.min("level").alias("level"))
        met = met.join(seed, ["node", *keys], "left_anti")
        return met.unionByName(seed.withColumn("level", F.lit(0))) if include_seeds else met

    def descendants(self, seeds: DataFrame, include_seeds: bool = False) -> DataFrame:
        """node and level (and other columns of ``seeds``, as a run's number, by each of which the question is asked)."""
        return self._closure(seeds, "source", "node", include_seeds)

    def ancestors(self, seeds: DataFrame, include_seeds: bool = False) -> DataFrame:
        return self._closure(seeds, "node", "source", include_seeds)

    def rerun_sets(self, events: DataFrame) -> DataFrame:
        """run_id, asset, kind: failed assets of every run and all below them, at once; names that no edge knows are ``missing``."""
        failed = events.where(F.col("event_type").isin("asset_failed", "node_failed")).select("run_id", F.col("asset").alias("node")).distinct()
        known = self.pairs.select("source").union(self.pairs.select("node")).distinct().toDF("node")
        below = self.descendants(failed.join(known, "node", "left_semi"), include_seeds=True)
        found = below.select("run_id", F.col("node").alias("asset"), F.when(F.col("level") == 0, "failed").otherwise("downstream").alias("kind"))
        return found.unionByName(failed.join(known, "node", "left_anti").select("run_id", F.col("node").alias("asset"), F.lit("missing").alias("kind")))
