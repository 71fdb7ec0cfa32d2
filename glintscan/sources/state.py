"""Scan state between runs: what was found in which version of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

FINDING = (
    "struct<type:string,description:string,match_content:string,confidence:double,file_context:string,"
    "severity:string,disposition:string,stage:int,line_no:int,pos:int,rule_no:int,match_no:int>"
)
IOC = "struct<ioc:string,stage:int,line_no:int,pos:int,rule_no:int,match_no:int>"
DEPENDENCY = "struct<manifest:string,name:string,version:string>"
SCHEMA = (
    f"path STRING, content_hash STRING, findings ARRAY<{FINDING}>, iocs ARRAY<{IOC}>, "
    f"dependencies ARRAY<{DEPENDENCY}>, repo STRING"
)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot; empty when there is none at ``path``, and an error for anything else that is wrong with it."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.sql("SELECT * FROM VALUES (1) AS t(x) WHERE false").select(
            *[F.lit(None).cast(t).alias(n) for n, t in [
                ("path", "string"), ("content_hash", "string"), ("findings", f"array<{FINDING}>"),
                ("iocs", f"array<{IOC}>"), ("dependencies", f"array<{DEPENDENCY}>"), ("repo", "string")]]
        )


def write_state(state: DataFrame, path: str) -> None:
    """Write a whole snapshot; to a new path when ``state`` was computed from the old one.

    Files follow the partitions of ``state``, which is grouped by (repo, path): a large repository is spread over
    all of them and small ones share them.  Sorting lets readers skip row groups by ``repo``.
    """
    state.sortWithinPartitions("repo", "path").write.mode("overwrite").parquet(path)
