import pytest


@pytest.fixture(scope="session")
def table(spark):
    """A DataFrame from rows and a schema, with columns of clashing names added."""
    def make(rows, schema, extra=True):
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("size", "n", "label", "node", "kept", "rep", "key", "row_id", "rank", "target"):
                if name not in df.columns:
                    df = df.selectExpr("*", f"7 AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
