import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("name", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("length", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "n", "f", "l") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, an id with two texts."""
    long = "".join(f"w{i % 97} x{i % 89} " for i in range(20000))
    return make_docs([(1, None), (2, ""), (3, "one"), (4, "one two"), (5, long), (6, long), (7, long + "z"), (8, "ümlaut ñandú 中文 text"), (8, "another text of eight"), (9, "one two"), (9, "one two"), (None, "no id here"), (None, None)])
