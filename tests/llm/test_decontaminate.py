"""Suffix-array decontamination against a plain search."""

import hashlib
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate as op

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, width):
    """(doc_id, n_words, n_hit, items) of each document."""
    out = []
    for d, text in docs:
        own, hit, found = words(text), set(), set()
        for item, told in items:
            w = words(told)
            k = min(width, len(w))
            for i in range(len(w) - k + 1) if k else ():
                for j in range(len(own) - k + 1):
                    if own[j : j + k] == w[i : i + k]:
                        hit |= set(range(j, j + k))
                        found.add("" if item is None else str(item))
        out.append((d, len(own), len(hit), tuple(sorted(found))))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def answered(df):
    return order([(r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in df.select("doc_id", "n_words", "n_hit", "hit_items").collect()])


def corpus(seed):
    rng = np.random.default_rng(seed)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(i, text(int(rng.integers(1, 60)), 12 if i % 3 else 400)) for i in range(25)] + [(99, "a " * 40), (99, "Zweiter   TEXT, gleich"), (None, "eins zwei drei vier"), (7, None), (8, "?!"), (5, "x" * 100 + " long word " + "y" * 70)]
    docs = [(i, text(int(rng.integers(0, 200)), 12 if i % 2 else 400)) for i in range(40)]
    for i in range(20):
        a, b = items[int(rng.integers(0, 25))][1].split(), text(30, 300)
        docs.append((100 + i, b + " " + " ".join(a[: int(rng.integers(1, len(a) + 1))]) + ". " + b))
    docs += [(200, "a " * 300), (201, None), (202, ""), (203, "zweiter text gleich"), (203, "zweiter text gleich"), (None, "eins-zwei\x00drei vier"), (204, "X" * 100 + " LONG word " + "Y" * 70)]
    return docs, items


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    for seed, width in ((1, 10), (2, 4), (3, 1)):
        docs, items = corpus(seed)
        d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id bigint, text string")
        want = order(brute(docs, items, width))
        assert answered(op.annotate(d, b, width=width)) == want
        assert answered(op.annotate(d, b, width=width, block_words=150)) == want


def test_longest_matches_and_removal(spark):
    item = " ".join(f"k{i}" for i in range(30))
    own = item.split()
    docs = [(1, "before " + " ".join(own[3:25]) + " after " + " ".join(own[10:20])), (2, "nothing here"), (3, None)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_hit", F.lit("own")), spark.createDataFrame([(5, item)], "item_id bigint, text string")
    row = op.annotate(d, b).where("doc_id = 1").first()
    assert [tuple(m) for m in row.matches] == [("5", 10, 24, 10), ("5", 3, 1, 22)] or sorted(map(tuple, row.matches)) == [("5", 3, 1, 22), ("5", 10, 24, 10)]
    assert (row.n_hit, row.n_hit_, [tuple(x) for x in row.hit_spans]) == ("own", 32, [(1, 23), (24, 34)])
    left = op.decontaminate(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(4)
    for n, v in ((0, 2), (1, 2), (50, 2), (400, 3), (300, 90)):
        text = rng.integers(0, v + 1, n)
        a = op.SuffixArray(text)
        tail = lambda i, t=text: tuple(t[i : next((j for j in range(i, len(t)) if t[j] == 0), len(t))])
        got = [tail(i) for i in a.order]
        assert got == sorted(got) and sorted(a.order) == list(np.flatnonzero(text))


def test_search_near_the_end_of_a_text():
    """Windows of all lengths, some settled while others are still searched, in texts whose least suffix is the last one."""
    rng = np.random.default_rng(6)
    texts = [np.array([2, 3, 1])] + [np.r_[rng.integers(0, 4, n) + (rng.random(n) < 0.5), 1] for n in (1, 5, 30, 200)]
    for text in texts:
        a = op.SuffixArray(text)
        windows = np.array([list(w[:k]) + [0] * (4 - k) for k in (1, 2, 3, 4) for w in rng.integers(1, 5, (60, 4))])
        lengths = (windows > 0).sum(1)
        for low, high, w, k in zip(*a.search(windows, lengths), windows, lengths, strict=True):
            assert sorted(a.order[low:high]) == [i for i in range(len(text) - k + 1) if (text[i : i + k] == w[:k]).all()]


def test_odd_input(spark, odd_docs, odd_rows, no_docs):
    items = [(1, odd_rows[0][1]), (2, "d \U0001f642 é"), (3, odd_rows[10][1])]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = op.annotate(odd_docs, b)
    assert set(odd_docs.columns) < set(got.columns)
    short = lambda rows: order([r for r in rows if r[0] != 9])  # noqa: E731  the long text has 30,000 words
    want = brute([r[:2] for r in odd_rows if r[0] != 9], [items[0], items[1], (3, " ".join(words(odd_rows[10][1])[:12]))], 10)
    assert short(answered(got)) == short(want)
    assert got.where("doc_id = 9").first().n_hit == 30_000
    assert op.annotate(no_docs, b).isEmpty()
    assert {r.n_hit for r in op.annotate(odd_docs, b.limit(0)).collect()} == {0}


def test_query_matches_sql(spark, tmp_path):
    docs, items = corpus(5)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op.op11_decontaminate(spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(op.ORACLE["op11_decontaminate"])
    at = [x[0] for x in want.description]
    assert order(map(tuple, got.select(at).collect())) == order(want.fetchall())
    sure = {r[0]: hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in brute(docs, items, 10)}
    assert all(sure[r.doc_id] == r.items_sha256 for r in got.collect() if r.doc_id != 203)
