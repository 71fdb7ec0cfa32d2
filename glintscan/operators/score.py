"""Risk score of a repository and simple counts over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glintscan import catalogue as K
from glintscan.sqltext import lookup


def risk_scores(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """``risk_score`` 0..100 per repository; repositories without findings score 0.

    Sums are taken per repository and type first, which makes the distinct
    count a plain count and leaves a handful of rows per hot repository.
    """
    weight = lookup(F.col("severity"), K.SEVERITY_WEIGHT, 1).cast("double")
    confidence = F.coalesce("confidence", F.lit(0.5))
    production = F.coalesce("file_context", F.lit("Production")) == "Production"
    per_type = findings.groupBy("repo", "type").agg(
        F.sum(weight * confidence).alias("weighted"), F.sum(weight).alias("weight"),
        F.count("*").alias("n"), F.count_if(production).alias("n_production"),
    )
    per_repo = per_type.groupBy("repo").agg(
        F.sum("weighted").alias("weighted"), F.sum("weight").alias("weight"), F.sum("n").alias("n"),
        F.sum("n_production").alias("n_production"), F.count("*").alias("types"),
    )
    score = (
        F.try_divide("weighted", "weight") * 100
        + F.least(F.col("n") * 0.5, F.lit(15.0))
        + F.least(F.col("types") * 3, F.lit(15))
        + F.when(F.try_divide("n_production", "n") > 0.5, 10).otherwise(0)
    )
    # rounded first, so that the order of summation cannot move a whole-number score
    scored = per_repo.select(
        "repo", F.least(F.floor(F.round(score, 9)), F.lit(100)).cast("int").alias("risk_score"),
        F.col("n").alias("finding_count"),
    )
    if repos is None:
        return scored
    return repos.select("repo").distinct().join(scored, "repo", "left").fillna(0, ["risk_score", "finding_count"])


def severity_rank(severity):
    return lookup(severity, K.SEVERITY_RANK, 99)


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo", severity_rank(F.col("severity")), "file", "type", "description")


def severity_type_counts(findings: DataFrame) -> DataFrame:
    """Counts by severity and counts by type in one pass."""
    value, kind = F.coalesce("severity", "type").alias("value"), F.when(F.grouping("severity") == 0, "severity").otherwise("type").alias("kind")
    return findings.groupingSets([["severity"], ["type"]], "severity", "type").agg(kind, F.count("*").alias("n")).select("kind", value, "n")


def report_metadata(repos: DataFrame, findings: DataFrame, others: list[DataFrame] = ()) -> DataFrame:
    """Targets, findings and critical findings in total; each input is reduced to one row first."""
    totals = [repos.select("repo").distinct().select(F.count("*").alias("targets"), F.lit(0).alias("f"), F.lit(0).alias("c"))]
    totals += [o.select(F.count("*").alias("targets"), F.lit(0).alias("f"), F.lit(0).alias("c")) for o in others]
    totals.append(findings.select(
        F.lit(0).alias("targets"), F.count("*").alias("f"), F.count_if(F.col("severity") == "CRITICAL").alias("c")))
    merged = totals[0]
    for t in totals[1:]:
        merged = merged.unionByName(t)
    return merged.agg(
        F.sum("targets").alias("targets"), F.sum("f").alias("findings"), F.sum("c").alias("critical_findings"))
