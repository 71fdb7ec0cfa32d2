"""Confidence model of a finding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintscan import catalogue as K
from glintscan.sqltext import contains_any, lookup


def entropy(s: Column) -> Column:
    """Shannon entropy over characters with the byte length as denominator.

    The characters are sorted once; each run of equal ones then adds its share.
    """
    total = F.octet_length(s).cast("double")

    def add(acc: Column, run: Column) -> Column:
        p = F.char_length(run) / total
        return acc - p * F.log2(p)

    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.when(s == "", 0.0).otherwise(F.aggregate(runs, F.lit(0.0), add))


def is_placeholder(s: Column) -> Column:
    return contains_any(F.lower(s), K.PLACEHOLDERS)


def assignment_tail(before: Column) -> Column:
    """Does the text end with ``=`` , ``:`` or ``=>``?  NULL when it is blank."""
    return F.when(F.rlike(before, F.lit(rf"[^{K.BLANK}]")),
                  F.rlike(before, F.lit(rf"(?:[=:]|=>)[{K.BLANK}]*+\z")))


def base_confidence(rule_id: Column) -> Column:
    return lookup(rule_id, K.BASE_CONFIDENCE, K.DEFAULT_CONFIDENCE)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def pattern_confidence(base: Column, match: Column, bits: Column, assigned: Column) -> Column:
    """Confidence of a rule match from its base value, entropy and surroundings."""
    by_entropy = F.when(F.octet_length(match) >= 16,
                        F.when(bits > 5.5, 0.1).when(bits < 3.5, -0.2).otherwise(0.0)).otherwise(0.0)
    by_context = F.when(assigned, 0.1).otherwise(0.0)
    return F.when(is_placeholder(match), 0.05).otherwise(clamp(base + by_entropy + by_context))


def entropy_confidence(e: Column) -> Column:
    return F.least((e - K.ENTROPY_LIMIT) / 2.0 + 0.3, F.lit(0.85))


UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z"
AWS_TYPES = ["AWS Key", "AWS Secret Key"]


def validated_confidence(ftype: Column, match: Column, confidence: Column) -> Column:
    """Second look at a finding: known samples and UUIDs are not secrets."""
    return (
        F.when(ftype.isin(AWS_TYPES) & is_placeholder(match), F.least(confidence, F.lit(0.05)))
        .when((ftype == "High Entropy String") & F.rlike(match, F.lit(UUID)), F.least(confidence, F.lit(0.05)))
        .otherwise(confidence)
    )
