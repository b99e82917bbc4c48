import pytest


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame with two columns whose names the operators use themselves."""

    def make(rows, schema):
        from pyspark.sql import functions as F

        clash = {c: F.lit("x") for c in ("h", "k", "fp", "shard_", "words", "score_", "found", "rank_")}
        return spark.createDataFrame(rows, schema).withColumns(clash)

    return make


DOCUMENTS = "doc_id long, text string, lang string, source string"
