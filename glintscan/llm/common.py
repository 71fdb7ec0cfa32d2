"""Helpers of the operators: tables in the shared folder, packed columns, row keys."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


@functools.lru_cache(maxsize=1)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local master (one process) gets a folder of its own; a cluster raises, because its
    machines share no temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _local_folder(spark.conf.get("spark.app.id", ""))
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder; every run takes another one."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again.

    This cuts the lineage: what comes after never repeats what came before, also when executors are lost. The
    files stay until the folder is cleaned, as those of ``checkpoint()`` do by default.
    """
    spark = frame.sparkSession
    path = new_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_hash(*columns: str) -> Column:
    """64 bits of the named columns, for telling rows of one id apart; nulls count."""
    return F.xxhash64(*[F.col(c) for c in columns])


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality of the named columns of two tables."""
    return functools.reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])
