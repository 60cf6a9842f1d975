import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as a table of documents with columns of clashing names."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("length", "offset", "shard", "size", "node", "word", "token", "rank", "count"):
                df = df.withColumn(name, F.lit(name))
        return df.repartition(3)

    return make
