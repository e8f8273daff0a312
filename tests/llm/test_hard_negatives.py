"""Cover trees and mined negatives against plain comparison of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives as op

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    own = set()
    for i, x, y in rows:
        if i is not None and x is not None and y is not None and all(v is not None and np.isfinite(v) for v in x):
            own.add((i, tuple(int(v) for v in np.floor(256 * np.asarray(x, np.float32).astype(float))), y))
    out = []
    for a in own:
        if a[0] % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(a[1], b[1], strict=True)), b[0], b[2], b[1]) for b in own if b != a and len(b[1]) == len(a[1])]
        for ps, pid, _, _ in sorted(s for s in scored if s[2] == a[2])[:positives]:
            fit = sorted(s for s in scored if s[2] != a[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps)
            out += [(a[0], pid, k, s[1], -ps, -s[0]) for k, s in enumerate(fit[:negatives], 1)]
    return sorted(out)


def answered(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def sample(seed, n=500, dim=6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, dim))
    rows = [(int(i), [float(v) for v in centre[i % 8] + 0.4 * rng.normal(size=dim)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, [1.0] * dim, i % 3) for i in range(150)]  # copies of one vector
    rows += [(50, [0.5] * dim, 1), (50, [0.5] * dim, 1), (50, [0.25] * dim, 2), (2000, [1.0] * (dim - 1), 1), (2001, [2.0] * (dim - 1), 1), (2003, [1.5] * (dim - 1), 0), (2050, [], 1), (2051, [], 2)]
    return rows + [(None, [1.0] * dim, 1), (3, None, 1), (100, [1.0] * dim, None), (150, [float("nan")] * dim, 1), (200, [None] * dim, 1), (250, [float("inf")] * dim, 1), (300, [0.0] * dim, 1), (301, [0.0] * dim, 2)]


@pytest.mark.parametrize("seed,cell_rows,seeds", [(1, 16384, 4096), (2, 60, 40)])
def test_mine_brute_force(spark, monkeypatch, seed, cell_rows, seeds):
    """Also with many cells and parts, and with a sample far smaller than the table."""
    monkeypatch.setattr(op, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(op, "SAMPLE", seeds)
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mark", F.lit("clash")).repartition(5)
    assert answered(op.mine(df, F.col("id") % 50 == 0)) == brute(rows)
    assert op.mine(df.limit(0), F.col("id") % 50 == 0).isEmpty()


def test_tree_windows(monkeypatch):
    """Windows of one tree, of small leaves; radii cover their rows."""
    monkeypatch.setattr(op, "LEAF", 5)
    rng = np.random.default_rng(5)
    x = np.floor(100 * rng.normal(size=(400, 4)) * rng.exponential(1, (400, 1))).astype(np.int64)
    x[100:160] = x[100]
    ids, labels, marks = rng.permutation(400), rng.integers(0, 3, 400), np.zeros(400, np.int64)
    tree = op.CoverTree(ids, marks, labels, x)
    square = (x * x).sum(1)
    y = np.c_[x, np.sqrt(square.max() - square)]
    for level in tree.levels:
        for a, b, c, r in zip(level["from"], level["to"], level["centre"], level["radius"], strict=True):
            assert np.sqrt(((y[tree.order[a:b]] - y[c]) ** 2).sum(1)).max() <= r + 1e-9
    assert sorted(np.concatenate([tree.order[a:b] for a, b in zip(tree.leaf_from, tree.leaf_to, strict=True)])) == list(range(400))
    score = x @ x[:50].T
    for same in (True, False):
        low, high = np.stack([np.full(50, -2000), np.full(50, 500)], 1), np.stack([np.full(50, 1000), np.full(50, 9000)], 1)
        who, window, s, row = tree.search(ids[:50], marks[:50], labels[:50], x[:50], low, high, 4, same)
        got = sorted(zip(who, window, -s, ids[row], strict=True))
        want = []
        for a in range(50):
            for w in range(2):
                fit = [(-score[r, a], ids[r]) for r in range(400) if r != a and (labels[r] == labels[a]) == same and low[a, w] <= score[r, a] <= high[a, w]]
                want += [(a, w, *t) for t in sorted(fit)[:4]]
        assert got == sorted(want)


def test_large_components(spark):
    big = 2.0**21
    rows = [(0, [big, 1.0, 0.0], 1), (1, [big, 2.0, 0.0], 1), (2, [big * 0.75, 2.0, 1.0], 2), (4, [big * 0.75, 2.0, 2.0], 2), (5, [-big, 2.0, 2.0], 2)]
    assert answered(op.mine(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0)) == brute(rows)
    far = spark.createDataFrame([(i, [v * 64 for v in x], y) for i, x, y in rows], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        op.mine(far, F.col("id") % 50 == 0).collect()
