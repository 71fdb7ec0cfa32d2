"""Severity, second look and triage of findings (row-local but for one fixed-size join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glintscan import catalogue as K
from glintscan.functions import confidence as C
from glintscan.sqltext import literal_table


def with_severity(findings: DataFrame, severity: dict[str, str] | None = None) -> DataFrame:
    table = literal_table(findings.sparkSession, list((severity or K.SEVERITY).items()), "type STRING, severity STRING")
    return findings.join(F.broadcast(table), "type", "left").withColumn(
        "severity", F.coalesce("severity", F.lit(K.DEFAULT_SEVERITY))
    )


def triage(findings: DataFrame, severity: dict[str, str] | None = None, keep_match: bool = False) -> DataFrame:
    """Adds ``severity`` and ``disposition`` (accept, candidate, discard).

    Serious findings are lifted to the acceptance limit first.  An accepted
    finding gives up its matched text unless ``keep_match`` is set.
    """
    second = C.validated_confidence(F.col("type"), F.col("match_content"), F.col("confidence"))
    serious = F.col("severity").isin("CRITICAL", "HIGH")
    lifted = F.when(serious, F.greatest(F.col("confidence"), F.lit(K.AUTO_ACCEPT))).otherwise(F.col("confidence"))
    disposition = (
        F.when(F.col("confidence") < K.AUTO_DISCARD, "discard")
        .when(F.col("confidence") >= K.AUTO_ACCEPT, "accept")
        .otherwise("candidate")
    )
    out = (
        with_severity(findings.withColumn("confidence", second), severity)
        .withColumn("confidence", lifted)
        .withColumn("disposition", disposition)
    )
    if keep_match:
        return out
    return out.withColumn("match_content", F.when(F.col("disposition") != "accept", F.col("match_content")))


def accepted(triaged: DataFrame) -> DataFrame:
    return triaged.where("disposition = 'accept'").drop("disposition")


def review_candidates(triaged: DataFrame) -> DataFrame:
    return triaged.where("disposition = 'candidate'").drop("disposition")


def above(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.where(F.col("confidence") >= threshold)
