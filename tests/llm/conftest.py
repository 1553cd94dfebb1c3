import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id -> text of the small documents table."""
    return {r["doc_id"]: r["text"] or "" for r in
            spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with columns that clash with names the operators use themselves."""
    def of(rows):
        rows = [(r + (None,) * 5)[:5] for r in rows]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        return docs.withColumns({c: F.lit(7) for c in (
            "row", "rank", "digest", "content", "kept", "fp", "shard", "slot", "cell", "path", "host",
            "lines", "hash", "run", "length", "start", "total", "_at", "p", "n")})
    return of


LONG = "word after word comes here and so on for long " * 20_000
#: null ids, null and empty and blank texts, repeated rows, ids with two texts, one long text
ODD = [(1, "same text here", "en", "a", 14), (1, "same text here", "en", "a", 14), (1, "another text", "en", "a", 12),
       (2, None, None, None, None), (3, "", "en", "", 0), (None, "same text here", None, "a", 14),
       (None, None, None, None, None), (4, " \t\n ", "xx", "b", 4), (5, LONG, "en", "http://H.example/p/q?x", 9),
       (6, "same  text\nhere", "fr", "c", 15)]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
