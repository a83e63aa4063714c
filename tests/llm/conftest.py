import pytest
from pyspark.sql import types as T

from odd_texts import TEXTS

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("size", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Every awkward text twice, null ids, sources and languages, and columns with names that operators use."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, "x", None) for i, t in enumerate(TEXTS)]
    rows += rows + [(None, "null id text here", "fr", "s1", None, "y"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
