"""Removing repeated findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glintscan.operators.detect import SEQUENCE


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row per repository, type, file and description."""
    return findings.dropDuplicates(["repo", "type", "file", "description"])


def dedup_key(by: str = "reference"):
    """Findings are the same when their matched text is, or failing that their description."""
    if by == "match":
        return F.col("match_content")
    return F.coalesce("match_content", "description")


def deduplicate(findings: DataFrame, by: str = "reference") -> DataFrame:
    """Keeps the most confident finding of each group and counts the group.

    The best row and the count are combined before the shuffle, so a group of
    any size arrives as one row per task.  The files of a group are not packed
    into one row, which would grow without limit: see ``finding_locations``.
    """
    cols = [c for c in findings.columns if c != "repo"]
    order = [c for c in SEQUENCE if c in cols]
    best = F.min_by(
        F.struct(*cols),
        F.struct((-F.coalesce("confidence", F.lit(0.5))).alias("c"), "file", *order, "description"),
    )
    return (
        findings.withColumn("dedup_key", dedup_key(by))
        .groupBy("repo", F.col("type").alias("dedup_type"), "dedup_key")
        .agg(best.alias("best"), F.count("*").alias("occurrence_count"))
        .select("repo", "best.*", "dedup_key", "occurrence_count")
    )


def finding_locations(findings: DataFrame, by: str = "reference") -> DataFrame:
    """Where each deduplicated finding occurs: one row per group and file, with repeats counted."""
    return (
        findings.withColumn("dedup_key", dedup_key(by))
        .groupBy("repo", "type", "dedup_key", "file")
        .agg(F.count("*").alias("hits"))
    )
