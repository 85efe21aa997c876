import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """Rows of (id, text) as documents, with columns whose names clash with those that operators use inside."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)
        if clash:
            for name in ("row_key", "node", "body", "kept", "term", "pos", "blob", "path", "ids", "digit", "stats", "word", "h", "n"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def rows():
    return lambda df: sorted(map(tuple, df.collect()), key=repr)
