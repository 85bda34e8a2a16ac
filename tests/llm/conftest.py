import pytest
from pyspark.sql import DataFrame

#: Names that clash with what the operators use inside.
EXTRA = {"key": "'k'", "pos": "1", "n": "2", "chunk": "3", "part": "4", "lang": "'en'", "source": "'s'", "n_chars": "CAST(5 AS BIGINT)", "keep": "true", "__id": "6", "row": "7", "doc": "8"}


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (id, text), with more columns than are needed."""

    def make(rows) -> DataFrame:
        return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string").selectExpr("doc_id", "text", *[f"{v} AS {k}" for k, v in EXTRA.items()]).coalesce(2)

    return make
