import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("_text", T.StringType()),
                     T.StructField("_len", T.IntegerType())])


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text[, lang, source]) rows as a documents table with clashing extra columns; null cells stay null."""

    def make(rows):
        full = [tuple(r) + (None,) * (4 - len(r)) + (None if r[1] is None else len(r[1]), "x", 3) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
