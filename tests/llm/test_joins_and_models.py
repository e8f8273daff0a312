"""Near copies and search against brute force; classifiers on held-out rows; the pipeline's stages."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import labelled, language_id, ngram_join, quality, topk_search, toxicity
from tidewatch.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, num, den):
    """(doc_id, set size, component) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    key = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(d, len(s), key[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def mutated(seed, n=160):
    """Families of near copies at many distances, short texts, repeated words, hot groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(14):
        size = int(rng.choice([2, 4, 9, 11, 14, 20, 35, 60, 120]))
        base = [f"w{int(x)}" for x in rng.integers(0, 400, size)]
        for _ in range(n // 14):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 12 + 1)))):
                own[int(rng.integers(0, size))] = f"x{int(rng.integers(0, 99999))}"
            rows.append(" ".join(own))
    rows += ["a " * k for k in (1, 2, 3, 5, 50)] + ["same text here"] * 9
    return [(int(i) * 3, t) for i, t in enumerate(rng.permutation(rows))]


@pytest.mark.parametrize("width,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2), (3, 60, 100, 3), (1, 75, 100, 4)])
def test_ngram_join_brute_force(spark, width, num, den, seed):
    rows = mutated(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.join_components(docs, width, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert order(got) == order(brute(rows, width, num, den))


def test_ngram_join_small_leaves_and_parts(spark, monkeypatch):
    """Trees of many nodes, cells of many parts, and empty blocks filed at once."""
    for name, value in (("LEAF", 2), ("PART", 8), ("SEARCHED", 50), ("COMPARED", 30), ("DEPTHS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = mutated(9, 300) + [(5000 + i, " ".join(f"c{i * 4 + k}" for k in range(24))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.join_components(docs, 3, 60, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert order(got) == order(brute(rows, 3, 60, 100))


def test_ngram_trees_find_all_pairs_that_points_allow():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.4, (300, ngram_join.GROUPS))
    counts[150:] = counts[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.03)
    lonely = rng.integers(0, 3, 300)
    x = np.concatenate([counts, lonely[:, None], (counts.sum(1) + lonely)[:, None]], 1)
    roots, limits = rng.integers(0, 40, 300), ngram_join.Limits(80, 100)
    for sides, tops in (([(0, 300)], [(0, 0)]), ([(0, 150), (150, 300)], [(0, 1)])):
        trees = ngram_join.Trees(x, roots, sides)
        begin = np.array([(trees.tops[i], trees.tops[j]) for i, j in tops])
        got = {(min(i, j), max(i, j)) for a, b in trees.meet(begin, np.array([1]), np.array([3]), limits) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = set()
        for i in range(300):
            for j in range(i):
                need = limits.need(x[i, -1] + x[j, -1])
                apart = len(sides) == 1 or (j < 150) != (i < 150)
                if apart and roots[i] != roots[j] and 1 <= lonely[i] + lonely[j] <= 3 and np.minimum(counts[i], counts[j]).sum() >= need and min(counts[i].sum(), counts[j].sum()) >= need:
                    want.add((j, i))
        assert got == want and got


def test_ngram_cells_of_overlapping_chunks_grow_in_proportion():
    """Texts cut from one long text with overlap: shingles are shared, but no two texts are alike."""
    pairs = []
    for n in (1000, 4000):
        words = [f"w{x}" for x in np.random.default_rng(1).integers(0, 50_000, 4 * n + 24)]
        limits, sizes = ngram_join.Limits(80, 100), Counter()
        for h in ngram_join.shingle_sets([" ".join(words[4 * i : 4 * i + 24]).encode() for i in range(n)], 5):
            sizes.update(limits.cells(h, len(h))[0].tolist())
        pairs.append(sum(k * (k - 1) // 2 for k in sizes.values()))
    assert pairs[1] < 4.5 * pairs[0]


def test_ngram_join_odd(spark, odd_docs, odd_rows, no_docs):
    got = ngram_join.join_components(odd_docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert order(got) == order(brute([r[:2] for r in odd_rows], 3, 90, 100))
    assert ngram_join.join_components(no_docs).isEmpty()
    assert ngram_join.keep_one(no_docs).isEmpty()


def test_ngram_join_given(spark):
    rows = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    assert order(ngram_join.op2_ngram_jaccard_join(spark, SF).collect()) == order(brute(rows, 3, 90, 100))


def test_linked_sets_share_a_cell():
    """Any two sets within the threshold share a cell in which pairs with as many lonely shingles are looked for."""
    rng, tried = np.random.default_rng(6), 0
    for num in (90, 80, 60):
        limits = ngram_join.Limits(num, 100)
        for n in (4, 10, 12, 19, 40, 250, 999):
            for _ in range(40):
                both = rng.integers(0, 2**64, n, np.uint64)
                most = int(n * (100 - num) / num * 0.5) + 2
                # shingles of one side alone that other sets have, and lonely ones
                (a, ua), (b, ub) = ((np.unique(np.r_[both, rng.integers(0, 2**64, int(rng.integers(0, most)), np.uint64)]), int(rng.integers(0, most))) for _ in range(2))
                if limits.linked(len(np.intersect1d(a, b)), len(a) + ua + len(b) + ub) and not (np.array_equal(a, b) and ua + ub == 0):
                    tried += 1
                    x, y = limits.cells(a, len(a) + ua), limits.cells(b, len(b) + ub)
                    _, i, j = np.intersect1d(x[0], y[0], return_indices=True)
                    assert (x[1][i] == y[1][j]).all() and (x[2][i] == y[2][j]).all()
                    assert ((x[1][i] <= ua + ub) & (ua + ub <= x[2][i])).any()
    assert tried > 200


def test_lonely_shingles_rule_out_no_partner():
    """A set without any partner loses at least ``spare`` shingles to each; a set with one loses fewer."""
    for num in (50, 75, 80, 90, 99, 100):
        limits = ngram_join.Limits(num, 100)
        for n in range(1, 120):
            fewest = min(k for k in range(n + 2) if k == n + 1 or not limits.linked(n - k, n + n - k))
            assert limits.spare(n) == fewest


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + int(x), 200) for x in range(30)] + [tuple(map(int, e)) for e in rng.integers(300, 360, (40, 2))] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").isEmpty()


def test_keep_one(spark):
    rows = mutated(9)
    want = {c for _, n, c in brute(rows, 5, 80, 100) if n}
    names = ("root", "row", "Row_", "__row", "node", "n")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r["doc_id"] for r in got} == want and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)


def search(rows, k=5):
    fit = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in fit.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in fit.items() if v != q and len(b) == len(a))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    return out


def test_topk_search(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1 + i % 3, 20).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(500, None), (550, [0.5, None]), (600, [float("nan")] * 20), (650, [float("inf")] * 20), (700, [1.0, 2.0]), (701, [3.0, 1.0]), (750, []), (751, []), (None, [1.0] * 20), (800, [9e9] * 20)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = topk_search.top_k(docs, F.col("id") % 50 == 0, query_block=4).collect()
    assert order(got) == order(search(rows))
    assert topk_search.top_k(docs.limit(0), F.col("id") % 50 == 0).isEmpty()


def test_topk_search_many_groups(spark, monkeypatch):
    """Queries are sent only to groups that can answer: few in clusters, and none is missed."""
    for name, value in (("GROUP_ROWS", 50), ("SAMPLE", 60)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(12)
    centre = rng.normal(0, 30, (8, 20))
    rows = [(i, (centre[i % 8] + rng.normal(0, 1, 20)).round(2).tolist()) for i in range(500)] + [(1000 + i, [1.0] * 20) for i in range(200)]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string").repartition(5)
    assert order(topk_search.top_k(docs, F.col("id") % 50 == 0, query_block=4).collect()) == order(search(rows))
    x = np.array([v for _, v in rows[:500]])
    bounds = [np.stack(b) for b in zip(*(topk_search._group_bounds(x[g::8]) for g in range(8)), strict=True)]
    reach = topk_search._reach(x, *bounds)
    score = x @ x.T
    assert all((reach[:, g] >= score[:, g::8].max(1)).all() for g in range(8))
    kth = np.sort(score, 1)[:, -6]
    assert (reach >= kth[:, None]).mean() < 0.5


def test_topk_search_repeated_queries(spark):
    """Equal query rows give one answer of k different neighbours; different rows of one id are answered each."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(0, 1, 8).round(2).tolist()) for i in range(1, 120)]
    rows += [rows[49], rows[49], (100, rng.normal(0, 1, 8).round(2).tolist())]  # 50 is there thrice, 100 with two vectors
    scaled = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, a in [scaled[49], scaled[99], scaled[-1]]:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in scaled if v != q)[:5]
        want += [(q, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk_search.top_k(docs, F.col("id") % 50 == 0, query_block=2).collect()
    assert order(got) == order(want)


def test_segment_bounds_hold():
    rng = np.random.default_rng(9)
    q, v = rng.integers(-99, 99, (20, 37)).astype(float), rng.integers(-99, 99, (30, 37)).astype(float)
    last = np.full((20, 30), np.inf)
    for s in topk_search.SEGMENTS:
        (m, d), (n, e) = topk_search.segment_stats(q, s), topk_search.segment_stats(v, s)
        bound = m @ n.T + d @ e.T
        assert (bound >= q @ v.T - 1e-6).all() and bound.mean() < last.mean()
        last = bound


def given(column, mod, held):
    c = duckdb.connect()
    sf = "/root/testdata/sf0.1"
    rows = c.execute(f"SELECT doc_id, text, {column} FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    out = ([], [])
    for i, t, y in rows:
        out[zlib.crc32(str(i).encode()) % mod == held].append((t, y))
    return out


def test_toxicity_held_out():
    learn, test = given("toxic", 5, 0)
    model = toxicity.fit(learn[:3000])
    p = model.probability(toxicity._raw(model, [t for t, _ in test])) >= 0.5
    y = np.array([y > 0 for _, y in test])
    assert (p == y).mean() >= 0.97 and p[y].mean() >= 0.8 and y[p].mean() >= 0.9  # accuracy, recall, precision
    word = lambda w: float(model.probability(toxicity._raw(model, [w]))[0])
    for w in ("idiot", "IDIOT!!", "i.d.i.o.t", "i d i o t", "1diot", "idioot", "st-up-id"):
        assert word(w) >= 0.5, w
    for w in ("the", "and", "ering", "thing"):
        assert word(w) < 0.5, w


def test_text_score_by_all_subsets():
    """The score of a text is the largest sum over one to three different words, or the lone word's, in plain Python."""
    rng = np.random.default_rng(9)
    for n in range(9):
        words = [f"{'abcdefg'[int(rng.integers(7))] * 4}{'.!,'[int(rng.integers(3))]}" for _ in range(n)]
        memo = {w: float(rng.normal(0, 1)) for w in words}
        best = defaultdict(lambda: toxicity.LOWEST)
        for w in words:
            best[w[:4]] = max(best[w[:4]], memo[w])
        top = max(best.values(), default=toxicity.LOWEST)
        sums = [sum(x) for k in (1, 2, 3) for x in combinations(best.values(), k) if k == 1 or min(x) > 0]
        assert toxicity.text_score(words, memo) == pytest.approx(max([*sums, toxicity.LONE * top if top > 0 else top]))


@pytest.mark.parametrize(("more", "lone"), [(0, 1.0), (1, 1.7), (2, 1.7), (3, 1.3), (toxicity.MORE, toxicity.LONE)])
def test_text_score_by_all_subsets_of_any_size(more, lone):
    rng = np.random.default_rng(10)
    for n in range(10):
        words = [f"{'abcdefg'[int(rng.integers(7))] * 4}{'.!,'[int(rng.integers(3))]}" for _ in range(n)]
        memo = {w: float(rng.normal(0, 1)) for w in words}
        best = {form: max(memo[w] for w in words if w[:4] == form) for form in {w[:4] for w in words}}
        top = max(best.values(), default=toxicity.LOWEST)
        sums = [sum(x) for k in range(1, more + 2) for x in combinations(best.values(), k) if k == 1 or min(x) > 0]
        assert toxicity.text_score(words, memo, more, lone) == pytest.approx(max([*sums, lone * top if top > 0 else top]))


def test_toxicity_fit_takes_little_memory():
    """The map of the landmarks holds their own features only, and gives the same kernels."""
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(4, 12))))) for _ in range(600)]
    text = lambda bad: " ".join(words[k] for k in rng.integers(0, 590, 20)) + (f" {words[590 + int(rng.integers(10))]}." if bad else ".")
    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    tracemalloc.start()
    model = toxicity.fit(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    assert toxicity.score_words([w.encode() for w in words[590:]], model.weight, model.offset).min() > toxicity.score_words([w.encode() for w in words[:590]], model.weight, model.offset).max()
    points, others = ([w.encode() for w in part] for part in (words[:50], words[50:]))
    used, row = toxicity._rows(points)
    phi = toxicity._dense(points)
    assert np.array_equal(toxicity._dense(points, row)[:-1], phi[used]) and not phi[row == len(used)].any()
    assert np.array_equal(toxicity._kernel(others, toxicity._dense(points, row), row), toxicity._kernel(others, phi))


def test_toxicity_other_scripts():
    """Insults in letters that are none of a to z are learnt, too."""
    words = "дом река небо стол книга город лето поле утро вечер".split()
    text = lambda i, bad: " ".join(words[(i * 3 + k) % 10] for k in range(8)) + (f" {bad}." if bad else ".")
    rows = [(text(i, ("негодяй", "бездарь")[i % 2]) + f" Слово {i}.", 1) for i in range(40)] + [(text(i, "") + f" Слово {i}.", 0) for i in range(80)]
    model = toxicity.fit(rows)
    p = model.probability(toxicity._raw(model, ["река небо негодяй стол", "река небо не-го-дяй стол", "река небо утро стол", "book table"]))
    assert p[0] > 0.5 and p[1] > 0.5 and p[2] < 0.5 and p[3] < 0.5


def test_toxicity_cross_validation():
    learn, _ = given("toxic", 5, 0)
    some = [r for r in learn if r[1]] + [r for r in learn if not r[1]][:120]
    out = toxicity.cross_validate(some, [(0, 1.0), (3, 1.0)], folds=2)
    assert set(out) == {(0, 1.0), (3, 1.0)} and all(h + m == sum(y for _, y in some) and loss > 0 for h, m, _, loss in out.values())


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i), i) for i in range(1, 21)] + [(3, "another", 7), (None, "none", 1), (30, None, 1)], "doc_id bigint, text string, n_chars bigint")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] + [(2, 1)], "doc_id bigint, toxic int")
    all_rows, _ = labelled.sample(docs, marks, "toxic", F.lit(True), 50)
    assert len(all_rows) == 20 and sum(y for _, y in all_rows) == 11  # one text an id, the largest label
    assert len(labelled.sample(docs, marks, "toxic", F.lit(True), 3)[0]) == 6
    some, _ = labelled.sample(docs, marks, "toxic", F.lit(True), 50, most_bytes=300, longest=100)
    assert 0 < sum(len(t) for t, _ in some) <= 300 and max(len(t) for t, _ in some) <= 100


def test_toxicity_edges(spark, odd_docs, no_docs):
    model = toxicity.fit([("you idiot there", 1), ("what an idiot", 1), ("the thing is here", 0), ("there it is", 0)])
    rows = {r["doc_id"]: r for r in toxicity.score(odd_docs, model).collect()}
    assert rows[4]["raw"] == rows[5]["raw"] == rows[8]["raw"] == toxicity.LOWEST and all(0 <= r["score"] <= 1 for r in rows.values())
    assert toxicity.score(no_docs, model).isEmpty() and toxicity.keep_clean(no_docs, model).isEmpty()
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    assert toxicity.fit([("a b c", 0)]) is None and {r["score"] for r in toxicity.score(odd_docs, None).collect()} == {0.0}
    spark_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.train(odd_docs, spark_labels) is None


def test_word_features_are_the_kernel():
    """Scores by feature weights equal kernels with the words that the weights are made of."""
    words = [b"idiot", b"idxiot", b"thing", b"the", b"worthless"]
    phi = toxicity._dense(words)
    own = toxicity.score_words(words, phi[:, 0].astype(float), 0.0)
    assert np.allclose(own, phi.T @ phi[:, 0], atol=1e-5)
    assert np.allclose(toxicity._kernel(words, phi), phi.T @ phi, atol=1e-5)
    assert own[1] > 0.4 > own[2]


def test_quality_held_out():
    learn, test = given("quality", 4, 2)
    model = quality.fit(learn[:3000])
    stats, words = quality.structure([t for t, _ in test], [None] * len(test))
    p = model.probability(model.raw(*model.encode(stats, [np.fromiter(map(quality.word_number, w), np.int64, len(w)) for w in words])))
    assert ((p >= 0.7) == np.array([y > 0 for _, y in test])).mean() >= 0.97


def test_sample_of_present_documents(spark):
    """Labels without a document or text use up no quota, and stored lengths reach the quality machine."""
    docs = spark.createDataFrame([(i, f"text {i}", 1000 * (i % 2) + 7) for i in range(40)] + [(i, None, 5) for i in range(40, 60)], "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, quality int")
    rows, sizes = labelled.sample(docs, labels, "quality", F.lit(True), 10)
    assert Counter(y for _, y in rows) == {0: 10, 1: 10}
    assert sizes == [1000 * y + 7 for _, y in rows]
    assert labelled.sample(docs.drop("n_chars"), labels, "quality", F.lit(True), 10) == (rows, [None] * 20)
    edges = quality.train(docs, labels, 10).edges[-1]  # of the stored length
    assert edges[0] == 7 and edges[-1] == 1007


def test_quality_sum_of_squares():
    """The linear-time form equals the sum over pairs."""
    rng = np.random.default_rng(3)
    m = quality.Model(np.zeros((0, 9)), 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = rng.integers(0, 50, 9), rng.normal(size=9)
    pairs = sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    assert m.raw(index, value, np.array([0]))[0] == pytest.approx(0.3 + m.w[index] @ value + pairs)


def test_quality_edges(odd_docs, no_docs):
    model = quality.fit([("the thing is here and there", 1), ("a b c d e f g", 1), ("$$$ %%% !!!", 0), ("no no no no no", 0)])
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(no_docs, model).isEmpty() and quality.keep_good(no_docs, model).isEmpty()
    assert quality.score(odd_docs.drop("n_chars"), model).count() == len(rows) and quality.fit([("x", 1)]) is None


def test_language_held_out(spark):
    c = duckdb.connect()
    lang = dict(c.execute("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = language_id.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.95


def test_language_edges(odd_docs, no_docs):
    model = language_id.fit([("the thing", "en"), ("and that", "en"), ("le la où", "fr"), ("für und", "de"), ("12", "xx")])
    rows = {r["doc_id"]: r for r in language_id.identify(odd_docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (4, 5, 6, 8)] == ["und"] * 4 and rows[4]["score"] == 0 and rows[1]["lang_pred"] in ("en", "fr", "de")
    assert language_id.identify(no_docs, model).isEmpty() and language_id.train(no_docs) is None
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, None).collect()} == {"und"}
    one = language_id.fit([("the thing", "en")])
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, one).collect()} == {"en", "und"}
    for c in (2, 3, 4, 5, 6, 20, 60):
        code = language_id.codewords(c)
        assert len({tuple(x) for x in code}) == c and (np.abs(code) == 1).all()


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps rows of its input only, and does its own work on it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.select("doc_id").count()
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= before
            assert out.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        if name == "line_dedup":
            assert out.count() == before
        if name == "near_copies":
            rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            want = brute(rows, 5, 80, 100)
            assert {r["doc_id"] for r in out.collect()} == {c for _, n, c in want if n} | {d for d, n, _ in want if not n}
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = out


def test_pipeline_edges(spark, odd_docs):
    """Odd rows go through every stage; an empty table stays empty."""
    docs = odd_docs.withColumn("a.dot", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).isEmpty(), name
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0 or name in ("quality", "toxicity")
