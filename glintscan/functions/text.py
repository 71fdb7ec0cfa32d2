"""Text clean-up, masking and fact lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintscan import catalogue as K
from glintscan.sqltext import FLAGS


def mask_secret(s: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), F.char_length(s).cast("string"), F.lit("]"))


def scrub(s: Column) -> Column:
    """Replace prompt-injection phrases and drop unprintable characters."""
    for p in K.SCRUB_PATTERNS:
        s = F.regexp_replace(s, FLAGS + p, "[SANITIZED]")
    return F.regexp_replace(s, r"[[\p{C}\p{Z}]&&[^\n\t ]]", "")


def clean_version(v: Column) -> Column:
    return F.ltrim(v, F.lit("^~>=<! "))


def short_hash(h: Column) -> Column:
    return F.concat(F.left(h, F.lit(20)), F.lit("..."))


def one_line(s: Column) -> Column:
    return F.replace(s, F.lit("\n"), F.lit(" "))


def finding_fact(severity: Column, ftype: Column, file: Column, description: Column) -> Column:
    na = lambda c: F.coalesce(c, F.lit("N/A"))
    return F.concat(
        F.lit("["), na(severity), F.lit("] "), na(ftype), F.lit(" | "), na(file), F.lit(" | "),
        one_line(na(description)),
    )


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)
