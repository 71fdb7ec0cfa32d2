"""Snapshots of files and of the scan state as tables bucketed by (repo, path), and the changes between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glintscan.sources.staging import shared_folder

KEY = ["repo", "path"]


def write_bucketed(rows: DataFrame, table: str, buckets: int) -> DataFrame:
    """Save ``rows`` as ``table``, one file a bucket, in the shared folder, and read it back.

    Two tables with as many buckets meet without an exchange, so content stays where it is. A bucket should fit the memory of
    a task without its content, which streams through: some 10 million files a bucket at most.
    """
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/tables/{table}"
    ordered = rows.repartition(buckets, *KEY)
    ordered.write.mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def changed_in_place(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (``repo``, ``path``, ``sha``, ...) whose hash the state does not hold, for tables bucketed alike.

    Files are streamed past a hash table of the state's keys and hashes, bucket by bucket: nothing is exchanged, content is
    read once and never sorted. Where the tables are not bucketed, ``plans.repository.changed_files`` moves keys only. A file
    with a null key is always new; a null hash equals a null hash.
    """
    known = state.groupBy(*KEY).agg(F.collect_set(F.coalesce("content_hash", F.lit(""))).alias("_known"))  # the versions of one file
    new = ~F.coalesce(F.array_contains("_known", F.coalesce("sha", F.lit(""))), F.lit(False))
    return files.join(known.hint("shuffle_hash"), KEY, "left").where(new).select(*files.columns)


def deleted_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Keys (``repo``, ``path``) that the state holds and ``files`` has no more."""
    return state.select(*KEY).distinct().join(files.select(*KEY), KEY, "left_anti")


def newest_changes(changes: DataFrame) -> DataFrame:
    """Of several changes (``repo``, ``path``, ``seq``, ...) of a file the one with the greatest ``seq``.

    Keys and numbers are compared; the content of a change moves only where Spark finds too many superseded ones to broadcast.
    """
    last = changes.groupBy(*KEY).agg(F.max("seq").alias("_last"))
    superseded = changes.select(*KEY, "seq").join(last, KEY).where("seq < _last").select(*KEY, "seq")
    return changes.join(superseded, [*KEY, "seq"], "left_anti")
