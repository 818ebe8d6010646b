import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns of names that operators might use themselves."""
    long = " ".join(f"w{i % 9973} v{i % 7919}" for i in range(150_000))
    rows = [
        (1, "plain words that say nothing much at all here", "en", "web"), (1, "plain words that say nothing much at all here", "en", "web"), (2, None, "en", "web"), (3, "", None, None),
        (None, "nobody can name this row of words", "en", "web"), (4, long, "en", "books"), (5, "   \n\t ", "xx", "web"), (6, "...!!!", "en", "web"), (7, "one", None, "web"), (None, None, None, None),
        (8, "plain words that say nothing much at all here", "en", "web"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "lang", "source"))])
    extra = {c: "x" for c in ("n_chars", "score", "keep", "toxic", "group_id", "component", "n", "h", "sig", "bands", "y", "item_id", "slot", "at", "key", "a", "b", "node", "url", "decision")}
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
