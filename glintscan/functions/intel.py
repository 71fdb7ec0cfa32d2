"""Reading third-party reports (VARIANT) and turning them into labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def variant_path(path: str) -> str:
    """``a.b.0.c`` → ``$.a.b[0].c``."""
    out = "$"
    for key in path.split("."):
        out += f"[{key}]" if re.fullmatch(r"\d+", key) else f"['{key}']"
    return out


def safe_get(doc: Column, path: str, dtype: str = "string", default=None) -> Column:
    """Value at a dotted path, or the default when any step is missing."""
    value = F.try_variant_get(doc, variant_path(path), dtype)
    return value if default is None else F.coalesce(value, F.lit(default))


MALICIOUS = "data.attributes.last_analysis_stats.malicious"


def detected(malicious: Column) -> Column:
    return F.coalesce(malicious > 0, F.lit(False))


def sheet_band(score: Column) -> Column:
    return F.when(score > 90, "crit").when(score > 70, "high").when(score > 40, "med").otherwise("none")


def document_band(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 40, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def abuse_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 50, "med").otherwise("none")


def count_or(malicious: Column, missing: str) -> Column:
    return F.coalesce(malicious.cast("string"), F.lit(missing))


def shodan_status(doc: Column) -> Column:
    error = safe_get(doc, "error")
    return F.when(doc.isNull(), None).when(error == "Not Found", "Não encontrado").when(
        F.coalesce(error, F.lit("")) != "", "Falha"
    ).otherwise("ok")


def urlhaus_status(doc: Column) -> Column:
    status = safe_get(doc, "query_status")
    return F.when(doc.isNull(), None).when(status == "ok", safe_get(doc, "url_status", default="N/A")).when(
        status == "no_results", "Não encontrado"
    ).otherwise("Falha")


def malwarebazaar_status(doc: Column) -> Column:
    status = safe_get(doc, "query_status")
    return F.when(status == "ok", safe_get(doc, "data.0.signature")).when(
        status == "hash_not_found", "Não encontrado"
    ).otherwise("Falha")


def virustotal_file_status(doc: Column) -> Column:
    malicious = safe_get(doc, MALICIOUS, "bigint")
    return F.when(safe_get(doc, "error") == "Not Found", "Não encontrado").otherwise(count_or(malicious, "Falha"))


def ip_link(ip: Column) -> Column:
    return F.concat(F.lit("https://www.virustotal.com/gui/ip-address/"), ip)


def abuse_link(ip: Column) -> Column:
    return F.concat(F.lit("https://www.abuseipdb.com/check/"), ip)


def file_link(sha256: Column) -> Column:
    return F.concat(F.lit("https://www.virustotal.com/gui/file/"), sha256)


def url_link(url: Column, report_id: Column) -> Column:
    """Report id when there is one (the middle part of ``u-<id>-…``), else a search link."""
    rid = F.when(F.startswith(report_id, F.lit("u-")), F.split_part(report_id, F.lit("-"), F.lit(2))).otherwise(report_id)
    search = F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    search = F.replace(search, F.lit("%7E"), F.lit("~"))
    return F.when(
        F.coalesce(rid, F.lit("")) != "", F.concat(F.lit("https://www.virustotal.com/gui/url/"), rid)
    ).otherwise(F.concat(F.lit("https://www.virustotal.com/gui/search/"), search))
