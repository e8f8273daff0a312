"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed letter trigrams (of lower-cased
UTF-8, other signs as spaces; square roots of relative counts) is fitted by regularised least squares. A text gets
the language whose codeword has the smallest loss against the classifiers' outputs; each bit counts for a language
by how well its classifier did on that language in training (loss-weighted decoding). If the best two losses are
close, the row is flagged as ambiguous.

Codes: all 2^(c-1) - 1 splits for up to five languages, else ``MAX_BITS`` columns, chosen greedily from a fixed
random pool for the largest distance between codewords.

The classifiers are fitted on the driver, on about ``PER_LANGUAGE`` documents of each language and ``MOST_ROWS`` in all
(chosen by hash of doc_id; with more languages each has fewer, but one at least); scoring runs in Spark tasks over whole texts.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without training rows every text is
``und``; with one language all others get that language with score 1; rows with null text or lang are not learnt from; repeated rows score
alike; a null id counts as crc32 0; extra columns are ignored; an empty table gives an empty result. Ties of loss go to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import id_crc, read, text_slices

PER_LANGUAGE, MOST_ROWS = 500, 3000
DIMENSIONS = 8192
MAX_BITS = 24
RIDGE = 0.03
#: Losses closer than this share of the best loss's range are ambiguous.
CLOSE = 0.15
UNKNOWN = "und"

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def codewords(c: int) -> np.ndarray:
    """(c, bits) of -1 and 1; all rows differ."""
    if c <= 5:
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in range(1, 2 ** (c - 1))] for i in range(c)], np.float64).reshape(c, -1)
    pool = np.random.default_rng(8).choice([-1.0, 1.0], (c, 40 * MAX_BITS))
    pool = pool[:, np.abs(pool.sum(0)) < c]
    chosen: list[int] = []
    distance = np.zeros((c, c))
    for _ in range(max(MAX_BITS, 2 * int(np.ceil(np.log2(c))))):
        gain = []
        for k in range(pool.shape[1]):
            d = distance + (pool[:, k][:, None] != pool[:, k][None, :])
            np.fill_diagonal(d, np.inf)
            low = d.min()
            gain.append((low, -(d == low).sum()) if k not in chosen else (-1.0, 0))
        best = max(range(pool.shape[1]), key=lambda k: gain[k])
        chosen.append(best)
        distance += pool[:, best][:, None] != pool[:, best][None, :]
    return pool[:, chosen]


def features(texts: list[str]) -> np.ndarray:
    """(n, DIMENSIONS) square roots of the shares of hashed trigrams."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(b"  " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8)
        b = data.astype(np.uint32)
        code = (b[:-2] * np.uint32(65537) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(2654435761) >> np.uint32(19)
        code = code[(data[1:-1] != 32) | (data[2:] != 32)]
        if len(code):
            out[i] = np.sqrt(np.bincount(code, minlength=DIMENSIONS) / len(code))
    return out


class Model:
    """Codewords, classifiers and weights of bits."""

    def __init__(self, languages: list[str], code: np.ndarray, weight: np.ndarray, offset: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weight, self.offset, self.trust = languages, code, weight, offset, trust

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, score, ambiguous) of each row of features."""
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        score = p.max(1) / p.sum(1)
        close = np.zeros(len(x), bool)
        if len(self.languages) > 1:
            sides = np.take_along_axis(loss, order[:, :2], 1)
            close = sides[:, 1] - sides[:, 0] < CLOSE
        return order[:, 0], score, close

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weight + self.offset
        if not self.code.shape[1]:
            return np.zeros((len(x), len(self.languages)))
        hinge = np.maximum(0, 1 - f[:, None, :] * self.code[None])
        return (hinge * self.trust[None]).sum(2)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Fits on (text, lang); None without rows."""
    rows = [(t, lang) for t, lang in rows if any(map(str.isalpha, t))]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages))
    at = np.array([languages.index(lang) for _, lang in rows])
    x = features([t for t, _ in rows]).astype(np.float64)
    share = 1 / np.bincount(at)[at]  # every language weighs the same
    s = np.sqrt(share / share.mean())
    mean = (x * (s * s)[:, None]).sum(0) / (s * s).sum()
    y = code[at]
    level = (y * (s * s)[:, None]).sum(0) / (s * s).sum()
    a = (x - mean) * s[:, None]
    gram = a @ a.T
    gram.flat[:: len(a) + 1] += RIDGE * np.trace(gram) / len(a)
    weight = a.T @ np.linalg.solve(gram, (y - level) * s[:, None])
    offset = level - mean @ weight
    right = np.sign(x @ weight + offset) == y
    trust = np.stack([right[at == k].mean(0) for k in range(len(languages))]) if code.shape[1] else np.zeros((len(languages), 0))
    trust = np.maximum(trust, 0.01) / np.maximum(trust, 0.01).sum(1, keepdims=True) if code.shape[1] else trust
    return Model(languages, code, weight.astype(np.float32), offset.astype(np.float32), trust)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """Fits on documents whose id's crc32 mod 4 is not 2 and whose lang is known."""
    rows = docs.where((id_crc() % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_language = max(1, min(per_language, most_rows // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, per_language / n) * 2**30))])
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) < share[F.col("lang")]).select("text", "lang")
    table = few.orderBy(F.xxhash64("text"), "lang").limit(2 * per_language * len(counts)).toArrow()
    return fit(sorted(zip(table.column("text").to_pylist(), table.column("lang").to_pylist(), strict=True)))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    told = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS weights a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for batch in batches:
            for i, j in text_slices(batch, limit=500_000):
                for k in range(i, j, 500):
                    part = batch.slice(k, min(500, j - k))
                    texts = part.column(1).to_pylist()
                    which, score, close = m.predict(features(texts))
                    known = np.array([any(map(str.isalpha, t)) for t in texts])
                    names = [m.languages[w] if ok else UNKNOWN for w, ok in zip(which, known, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array(close | ~known)], schema.names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
