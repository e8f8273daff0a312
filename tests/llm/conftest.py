import pytest
from pyspark.sql import functions as F

#: Columns whose names operators might use themselves.
CLASHES = ("row", "node", "key", "n", "shard", "slot", "line", "pos", "root", "length", "rank", "score", "raw", "piece", "target", "free", "__row", "__k", "block", "salt")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, odd characters and one long text."""
    words = "the anger of thed erion then nd stion reha onwh er inea tion that".split()
    text = " ".join(words[(i * 7 + i // 3) % len(words)] + ("." if i % 9 == 0 else "") for i in range(60))
    long = " ".join(f"{words[i % len(words)]}{i % 977}" for i in range(30_000))
    return [
        (1, text, "en", "s1", len(text)), (2, text, "en", "s2", None), (2, text, "en", "s2", None), (3, text + " more", None, None, 3), (None, text, "en", "s3", 5),
        (4, None, "en", "s1", None), (5, "", None, "s1", 0), (6, " \n\t ", "fr", "s4", 4), (7, "le la é ê où", "fr", "s4", 12), (8, "1234 !!", "de", "s4", 7),
        (9, long, "en", "s5", len(long)), (None, None, None, None, None), (10, "a\x00b \x1c c d \U0001f642 é", "en", "s1", 9), (11, "Wort für Wort ÄÖÜ ß", "de", "s6", 18),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
