import pytest


@pytest.fixture(scope="session")
def tables(tmp_path_factory):
    """A function that writes rows as Parquet and returns the frame read back."""
    def make(spark, rows, schema, name="t"):
        path = str(tmp_path_factory.mktemp("tables") / name)
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make
