import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang) rows, with clashing extra columns on request."""

    def build(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return build
