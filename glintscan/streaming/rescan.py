"""Incremental re-scan over a stream of files.

Every micro-batch is scanned with the batch plan and appended as state rows,
partitioned by batch.  A batch that runs again after a failure replaces its own
partition, so the sink holds every row once; the newest row of a file counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from glintscan.catalogue import Rule
from glintscan.plans.repository import scanned_state


def rescan_stream(files: DataFrame, sink: str, checkpoint: str, rules: Sequence[Rule] | None = None) -> DataStreamWriter:
    """``files`` is a streaming ``(repo, path, name, sha, content)``; call ``start()`` on the result."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        (
            scanned_state(batch, rules).withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)
        )

    return files.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def latest(state_log: DataFrame) -> DataFrame:
    """The newest row of every file; combined before the shuffle."""
    cols = [c for c in state_log.columns if c not in ("repo", "path", "batch_id")]
    return state_log.groupBy("repo", "path").agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select("repo", "path", "s.*")
