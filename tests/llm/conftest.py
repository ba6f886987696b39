import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table from (doc_id, text) pairs."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        for c in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return make
