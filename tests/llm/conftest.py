import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """A documents table with an extra column whose name clashes with internals."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    return make
