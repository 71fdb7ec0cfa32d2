"""Keeping intermediate results in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or where it is unset the warehouse.

    The driver and all executors of a cluster must share it: a warehouse that is left at its default is a folder beside the driver,
    which only a local master can use.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def stage(df: DataFrame) -> DataFrame:
    """Write a result that is needed more than once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-scan.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
