import pytest

#: Names that the operators use inside, as extra columns of their inputs.
CLASHES = ["fp", "part", "line", "w", "n", "tokens", "ids", "rate", "p", "block", "words", "component_id", "host",
           "shard_", "body", "d", "__cl_first", "__cl_lang", "node", "root", "score_", "vid", "key"]


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("extra") for c in CLASHES})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


MESSY = [(1, "The quick brown fox jumps over the lazy dog\nand runs away from it"), (2, None), (3, ""), (4, "   \n\t "),
         (5, "one"), (6, "The quick brown fox jumps over the lazy dog\nand runs away from it"), (None, "a text without an id here"),
         (7, "1234 5678 !!"), (8, "wörd élan Ñandú ß œuvre naïve"), (9, "長い文章 と 𝒜 emoji 😀 text"), (10, "word " * 30_000),
         (11, "x" * 5_000), (5, "one"), (5, "another text under the same id"), (12, "tab\tand\r\nreturn\x0band\x1cfile sep")]


@pytest.fixture(scope="session")
def messy(spark):
    return with_clashes(docs_frame(spark, MESSY))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """A few hundred generated documents of the smallest table, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
