import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """``files`` rows from ``{path: content}``, all in one repository."""
    def make(contents, repo="r"):
        rows = [(repo, p, p.rsplit("/", 1)[-1], c) for p, c in contents.items()]
        return spark.createDataFrame(rows, "repo string, path string, name string, content string")

    return make


@pytest.fixture(scope="session")
def scan(files):
    """Findings and indicators of a few files as plain rows."""
    from glintscan.operators import detect

    def run(contents, rules=None):
        rows = detect.hits(files(contents), rules).collect()
        return [r for r in rows if r.row_kind == "finding"], [r for r in rows if r.row_kind == "ioc"]

    return run
