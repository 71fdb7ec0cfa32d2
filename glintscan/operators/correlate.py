"""Findings that gain weight from what else is in the same file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Finding types and output texts (fixed values).
EVAL_TYPES = ["Suspicious JS Keyword", "Remote Code Loading", "Encoded Payload Execution"]
ENTROPY_TYPES = ["High Entropy String"]
EVAL_AND_URL = " [CORRELADO: eval + URL externa no mesmo arquivo]"
ENTROPY_AND_URL = " [CORRELADO: payload ofuscado + URL externa]"
ENTROPY_AND_EVAL = " [CORRELADO: entropia alta + eval no mesmo arquivo]"


def mark_correlated(rows: DataFrame, has_ioc) -> DataFrame:
    """``rows`` hold findings and whatever tells ``has_ioc``, partitioned by file."""
    in_file = Window.partitionBy("repo", "file")
    is_eval, is_entropy = F.col("type").isin(EVAL_TYPES), F.col("type").isin(ENTROPY_TYPES)
    with_eval = F.max(F.coalesce(is_eval, F.lit(False))).over(in_file)
    with_entropy = F.max(F.coalesce(is_entropy, F.lit(False))).over(in_file)
    both = F.col("_eval") & F.col("_url")
    fresh = ~F.coalesce("correlated", F.lit(False))
    case = (
        F.when(fresh & both & is_eval, F.struct(F.lit("HIGH").alias("s"), F.lit(EVAL_AND_URL).alias("t")))
        .when(fresh & both & is_entropy, F.struct(F.lit("HIGH").alias("s"), F.lit(ENTROPY_AND_URL).alias("t")))
        .when(fresh & ~both & F.col("_eval") & F.col("_entropy") & is_entropy,
              F.struct(F.lit("MEDIUM").alias("s"), F.lit(ENTROPY_AND_EVAL).alias("t")))
    )
    return (
        rows.withColumn("_eval", with_eval).withColumn("_entropy", with_entropy)
        .withColumn("_url", F.max(has_ioc).over(in_file))
        .withColumn("_case", case)
        .withColumn("severity", F.coalesce("_case.s", "severity"))
        .withColumn("description", F.concat("description", F.coalesce("_case.t", F.lit(""))))
        .withColumn("correlated", F.coalesce("correlated", F.col("_case").isNotNull()))
        .drop("_eval", "_entropy", "_url", "_case")
    )


def correlate(findings: DataFrame, iocs: DataFrame) -> DataFrame:
    """Adds ``correlated``; only findings that can change and one row per indicator file are shuffled.

    Groups are single files, whose size is limited; findings of other types,
    among them the repository-wide ones, pass through untouched.
    """
    if "correlated" not in findings.columns:
        findings = findings.withColumn("correlated", F.lit(None).cast("boolean"))
    subject = F.col("type").isin(EVAL_TYPES + ENTROPY_TYPES)
    with_url = iocs.select("repo", F.col("source_file").alias("file")).distinct().withColumn("_ioc", F.lit(True))
    rows = findings.where(subject).withColumn("_ioc", F.lit(False)).unionByName(with_url, allowMissingColumns=True)
    marked = mark_correlated(rows, F.col("_ioc")).where(~F.col("_ioc")).drop("_ioc")
    rest = findings.where(~subject).withColumn("correlated", F.coalesce("correlated", F.lit(False)))
    return marked.unionByName(rest)
