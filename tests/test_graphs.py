"""Components, cycle paths and the reachability index against plain searches."""

from collections import defaultdict

import numpy as np

from tidewatch.operators import graphs, lineage


def reach(edges):
    """node -> {reached: least number of edges}"""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for s in {x for e in edges for x in e}:
        seen, now, level = {}, {s}, 0
        while now:
            level += 1
            now = {b for a in now for b in out[a]} - set(seen)
            seen |= {b: level for b in now}
        found[s] = seen
    return found


def random_edges(seed, n=40, m=55):
    rng = np.random.default_rng(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, n, (m, 2)).tolist()})


def frame(spark, edges):
    return spark.createDataFrame(edges, "parent string, child string")


def test_components_and_paths(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    between = [("r3", "x"), ("x", "y"), ("y", "q1"), ("q1", "q2"), ("q2", "q1"), ("z", "r0"), ("q2", "end"), ("s", "s")]
    for edges in (random_edges(1), ring + between):
        ways = reach(edges)
        want = {}
        for a, seen in ways.items():
            if a in seen:
                own = sorted(b for b in seen if a in ways[b])
                want[a] = (own[0], len(own))
        found = graphs.strong_components(frame(spark, edges))
        got = {r["node"]: (r["component"], r["size"]) for r in found.collect()}
        assert got == want
        paths = {r["component"]: (r["size"], r["path"]) for r in graphs.cycle_paths(frame(spark, edges), found).collect()}
        assert set(paths) == {c for c, _ in want.values()}
        for c, (size, path) in paths.items():
            assert path[0] == path[-1] == c and all(e in set(edges) for e in zip(path, path[1:], strict=False)) and len(path) - 1 == ways[c][c] and size == want[c][1]
    assert "x" not in got and graphs.cycle_paths(frame(spark, [("a", "b"), ("b", "c")])).isEmpty()


def test_find_cycles_tells_less_than_components(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("d", "e")]
    assert {r["node"] for r in lineage.find_cycles(frame(spark, edges)).collect()} == set("abmcd")
    assert {r["node"] for r in graphs.strong_components(frame(spark, edges)).collect()} == set("abcd")


def test_topo_levels(spark):
    """Longest paths, for chains of odd and even length, and nodes below a cycle left out."""
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(21)] + [("c00", "c07"), ("c03", "d"), ("d", "c20"), ("k", "l"), ("l", "k"), ("l", "c21"), ("alone", "after")]
    want = {f"c{i:02}": i for i in range(21)} | {"d": 4, "alone": 0, "after": 1}
    assert {r["node"]: r["level"] for r in lineage.topo_levels(frame(spark, edges)).collect()} == want


def test_reachability(spark):
    edges = random_edges(3, 60, 70) + [(f"z{i:02}", f"z{i + 1:02}") for i in range(33)]
    ways, index = reach(edges), graphs.Reachability.build(frame(spark, edges))
    assert index.rounds == 7  # ways of up to 33 edges: 2, 4, 8, 16, 32, 64, and one that finds nothing
    got = {(r["source"], r["node"]): r["level"] for r in index.pairs.collect()}
    assert got == {(a, b): n for a, seen in ways.items() for b, n in seen.items() if a != b}
    seeds = spark.createDataFrame([("z05",), ("z30",), ("n01",)], "node string")
    for whole in (True, False):
        for a, b in ((index.descendants(seeds, whole), lineage.descendants(frame(spark, edges), seeds, whole)), (index.ancestors(seeds, whole), lineage.ancestors(frame(spark, edges), seeds, whole))):
            assert sorted(map(tuple, a.select("node", "level").collect())) == sorted(map(tuple, b.select("node", "level").collect()))
    events = spark.createDataFrame([(1, "asset_failed", "z30"), (1, "asset_failed", "nowhere"), (2, "asset_failed", "z32"), (2, "asset_succeeded", "z01")], "run_id int, event_type string, asset string")
    found = index.rerun_sets(events)
    for run in (1, 2):
        want = lineage.rerun_set(events, frame(spark, edges), run)
        assert sorted(map(tuple, found.where(f"run_id = {run}").select("asset", "kind").collect())) == sorted(map(tuple, want.select("asset", "kind").collect()))
