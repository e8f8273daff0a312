"""A training corpus from raw documents, in five stages.

Toxic documents go, poor documents go, cross-site boilerplate lines go, one document of each group of near copies
stays, and what is left is tokenised and packed into sequences. Every stage takes and returns all that its
predecessor kept; all but the last return the columns of ``documents``. Classifiers are fitted on the documents
that the stage gets and the table ``labels``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, ngram_join, packing, quality, toxicity
from tidewatch.llm.common import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over ten sites or more; n_chars follows the text."""
    cut = line_dedup.drop_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component linked at a Jaccard of 0.8 of 5-word shingles."""
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line_dedup", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]

#: No SQL expresses the classifiers; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table is deleted once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark, name)
        docs = own.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.delete()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
