"""Rules from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glintscan import catalogue as K
from glintscan.catalogue import Rule
from glintscan.sqltext import literal_table

MAX_RULES = 10_000


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """JSON lines ``{"id", "pattern"}`` → rules; rows without an id or a pattern are skipped.

    Rules become literals of the plan, so they come to the driver; a file that
    is no rule file is refused instead of collected.
    """
    table = spark.read.schema("id STRING, pattern STRING").json(path).where(
        "coalesce(id, '') <> '' AND coalesce(pattern, '') <> ''"
    )
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules in {path}")
    return [Rule(r["id"], r["pattern"]) for r in rows]


def rule_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as rows: id, pattern, kind, severity, base confidence."""
    rules = K.shipped_rules() if rules is None else rules
    return literal_table(
        spark,
        [(r.id, r.pattern, r.klass, K.SEVERITY.get(r.id, K.DEFAULT_SEVERITY),
          K.BASE_CONFIDENCE.get(r.id, K.DEFAULT_CONFIDENCE)) for r in rules],
        "id STRING, pattern STRING, kind STRING, severity STRING, base_confidence DOUBLE",
    )


def rule_kind(rule_id):
    """Column form of the rule class."""
    return F.when(F.rlike(F.lower(rule_id), F.lit("|".join(K.SUSPICIOUS_WORDS))), K.SUSPICIOUS).otherwise(K.SECRET)
