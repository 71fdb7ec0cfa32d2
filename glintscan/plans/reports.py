"""Report tables, one DataFrame per sheet, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glintscan.functions import intel as I
from glintscan.functions import network as N


def alerted(indicator: Column) -> Column:
    warning = N.visual_spoofing(indicator)
    return F.when(
        warning.isNotNull(), F.concat(F.lit("⚠️ ALERTA ("), warning, F.lit("): "), N.defang(indicator))
    ).otherwise(N.defang(indicator))


def repo_summary(scores: DataFrame) -> DataFrame:
    return scores.select(
        F.col("repo").alias("url"), F.concat(F.col("risk_score").cast("string"), F.lit("/100")).alias("risk"),
        I.sheet_band(F.col("risk_score")).alias("band"),
        I.document_band(F.col("risk_score")).alias("level"),
    )


def repo_findings(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Every finding, and one row for each repository that has none."""
    some = findings.select(F.col("repo").alias("url"), "severity", "description", "type", "file")
    clean = repos.select("repo").distinct().join(findings.select("repo").distinct(), "repo", "left_anti").select(
        F.col("repo").alias("url"), F.lit("Nenhum achado").alias("severity"),
        *[F.lit("-").alias(c) for c in ("description", "type", "file")])
    return some.unionByName(clean)


def repo_dependencies(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("repo").alias("url"), "manifest", F.col("name").alias("package"), "version")


def repo_iocs(iocs: DataFrame) -> DataFrame:
    malicious = I.safe_get(F.col("virustotal"), I.MALICIOUS, "bigint")
    return iocs.select(
        F.col("repo").alias("url"), alerted(F.col("ioc")).alias("ioc"), "source_file",
        I.count_or(malicious, "N/A").alias("vt_detections"), I.detected(malicious).alias("detected"),
    )


def ip_report(ips: DataFrame) -> DataFrame:
    """``ips(ip, virustotal, abuseipdb, shodan)`` → eleven columns and two flags."""
    vt, abuse, shodan = F.col("virustotal"), F.col("abuseipdb"), F.col("shodan")
    malicious = I.safe_get(vt, I.MALICIOUS, "bigint")
    score = I.safe_get(abuse, "data.abuseConfidenceScore", "bigint")
    status = I.shodan_status(shodan)

    def when_ok(value: Column) -> Column:
        return F.when(status == "ok", value).otherwise(status)

    def listed(name: str) -> Column:
        return F.coalesce(I.safe_get(shodan, name, "array<string>"), F.array().cast("array<string>"))

    vulns = F.array_join(listed("vulns"), ", ")
    return ips.select(
        N.defang(F.col("ip")).alias("ip"), I.ip_link(F.col("ip")).alias("vt_link"), I.abuse_link(F.col("ip")).alias("abuse_link"),
        I.count_or(malicious, "Falha").alias("vt_detections"), I.count_or(score, "Falha").alias("abuse_score"),
        I.safe_get(abuse, "data.countryCode", default="N/A").alias("country"),
        I.safe_get(vt, "data.attributes.as_owner", default="N/A").alias("provider"),
        when_ok(F.array_join(listed("ports"), ", ")).alias("ports"),
        when_ok(I.safe_get(shodan, "org", default="N/A")).alias("organization"),
        when_ok(F.array_join(F.transform(listed("hostnames"), N.defang), ", ")).alias("hostnames"),
        when_ok(F.when(vulns == "", "Nenhuma").otherwise(vulns)).alias("cves"),
        I.detected(malicious).alias("detected"), I.abuse_band(score).alias("abuse_band"),
    )


def url_report(urls: DataFrame) -> DataFrame:
    """``urls(url, virustotal, urlhaus)`` → link, counts, status and tags."""
    vt, urlhaus = F.col("virustotal"), F.col("urlhaus")
    malicious = I.safe_get(vt, I.MALICIOUS, "bigint")
    tags = F.array_join(F.coalesce(I.safe_get(urlhaus, "tags", "array<string>"), F.array().cast("array<string>")), ", ")
    ok = I.safe_get(urlhaus, "query_status") == "ok"
    return urls.select(
        alerted(F.col("url")).alias("url"), I.url_link(F.col("url"), I.safe_get(vt, "data.id")).alias("vt_link"),
        I.count_or(malicious, "Falha").alias("vt_detections"), I.urlhaus_status(urlhaus).alias("urlhaus_status"),
        F.when(urlhaus.isNotNull(), F.when(ok & (tags != ""), tags).otherwise("N/A")).alias("urlhaus_tags"),
        I.detected(malicious).alias("detected"),
    )


def file_report(files: DataFrame) -> DataFrame:
    """``files(sha256, filename, virustotal, malwarebazaar)`` → the file sheet."""
    vt, mb = F.col("virustotal"), F.col("malwarebazaar")
    malicious = I.safe_get(vt, I.MALICIOUS, "bigint")
    known = malicious.isNotNull() & (F.coalesce(I.safe_get(vt, "error"), F.lit("")) != "Not Found")

    def if_known(path: str) -> Column:
        return F.when(known, I.safe_get(vt, path, default="N/A")).otherwise("N/A")

    return files.select(
        F.coalesce("filename", F.lit("N/A")).alias("filename"), "sha256", I.file_link(F.col("sha256")).alias("vt_link"),
        I.virustotal_file_status(vt).alias("vt_detections"), I.malwarebazaar_status(mb).alias("threat_name"),
        if_known("data.attributes.trid.0.file_type").alias("file_type"), if_known("data.attributes.size").alias("size"),
        I.detected(malicious).alias("detected"),
    )


def spoofing_warnings(url_targets: DataFrame, iocs: DataFrame) -> DataFrame:
    """Suspicious spellings among URL targets and extracted indicators."""
    indicator = F.col("indicator")
    every = url_targets.select(F.col("url").alias("indicator")).union(iocs.select(F.col("ioc").alias("indicator"))).distinct()
    return every.select(N.visual_spoofing(indicator).alias("warning"), N.defang(indicator).alias("indicator")).where(
        "warning IS NOT NULL")


def write_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per sheet; ``fmt`` is parquet, csv or json."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path.rstrip('/')}/{name}")
