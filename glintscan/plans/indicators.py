"""Look-ups of indicator lists and of files by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glintscan.operators.lookup import merge_sources
from glintscan.plans import reports
from glintscan.sources.files import file_hashes
from glintscan.sources.targets import classify_targets


def indicator_reports(lines: DataFrame, ip_sources: dict[str, DataFrame], url_sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Target lines → IP and URL report; a source is ``(ip or url, report VARIANT)``."""
    targets = classify_targets(lines).where("kind <> 'rejected'").distinct()
    ips = targets.where("kind = 'ip'").selectExpr("target AS ip")
    urls = targets.where("kind = 'url'").selectExpr("target AS url")
    return {
        "ips": reports.ip_report(merge_sources(ips, "ip", ip_sources)),
        "urls": reports.url_report(merge_sources(urls, "url", url_sources)),
    }


def hash_report(entries: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """``entries(path, content)`` → one report row per content hash."""
    return reports.file_report(merge_sources(file_hashes(entries), "sha256", sources))
