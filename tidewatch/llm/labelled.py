"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of text of a sample, and of one of its texts, at most.
MOST_BYTES, LONGEST = 64_000_000, 1_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, most_bytes: int = MOST_BYTES, longest: int = LONGEST) -> tuple[list[tuple[str, int]], list[int | None]]:
    """(text, label) and stored lengths (n_chars) of at most ``per_class`` documents of label 0 and of label 1.

    ``train`` is the condition on ``doc_id`` under which a label may be learnt. The rows are those with the
    smallest hashes of doc_id, as far as their texts fill ``most_bytes``; texts of more than ``longest`` bytes are not learnt from.
    Rows without id, label or text take no part, and labels whose document is not
    in ``docs`` use up none of the bound; if an id has several labels, the largest counts; if it has several
    texts, that of the smallest hash does. The labels are bounded before they are joined with the texts, so the broadcast side
    has at most 2 * per_class rows. Without a column n_chars all lengths are None.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(F.max(label).alias("y"))
    fit = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    own = own.join(fit.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = own.where("y = 0").orderBy(*order).limit(per_class).unionByName(own.where("y = 1").orderBy(*order).limit(per_class))
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    rows = fit.select("doc_id", "text", n_chars.alias("n_chars")).join(F.broadcast(few), "doc_id")
    one = F.min_by(F.struct("text", "n_chars", F.col("y").cast("int").alias("y")), F.struct(F.xxhash64("text"), "n_chars"))
    rows = rows.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of 2 * per_class rows at most
    table: pa.Table = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).orderBy("doc_id").select("text", "y", "n_chars").toArrow()
    return list(zip(table.column("text").to_pylist(), table.column("y").to_pylist(), strict=True)), table.column("n_chars").to_pylist()


def logistic(x, y, rounds: int = 50, ridge: float = 1e-2, balanced: bool = True):
    """Slope and offset of a logistic curve through scores x with labels y, by Newton steps (Platt's targets).

    ``balanced``: both labels weigh the same in sum.
    """
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(y) if balanced else np.ones(len(y))
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - target)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 5)
    return float(w[0]), float(w[1])
