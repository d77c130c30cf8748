import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""
    def make(rows, schema="doc_id long, text string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit("x") for c in ("h", "d", "w", "key", "n_words", "fp", "score", "b", "token", "rest", "sha")})
    return make
