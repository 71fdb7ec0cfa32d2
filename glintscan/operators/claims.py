"""Checking texts against what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glintscan import catalogue as K
from glintscan.functions import intel as I
from glintscan.functions import text as T
from glintscan.sqltext import FLAGS


KINDS = ("ip", "url", "hash")


def claims(texts: DataFrame) -> DataFrame:
    """``texts(text_id, text)`` → distinct ``(text_id, kind, value)`` named in the text."""
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(FLAGS + p), F.lit(0)).alias("values"))
        for kind, p in zip(KINDS, (K.CLAIM_IP, K.CLAIM_URL, K.CLAIM_HASH), strict=True)
    ])
    return (
        texts.select("text_id", F.inline(found))
        .select("text_id", "kind", F.explode("values").alias("value")).distinct()
    )


def unsupported_claims(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Claims that ``known(kind, value)`` does not hold.

    URLs and hashes are only checked when there is something of their kind to
    check against.  Spark splits a value that many texts name.
    """
    kinds = known.where(F.col("kind").isin(*KINDS)).select("kind").distinct()  # three rows at most
    values = known.select("kind", "value", F.lit(True).alias("known")).distinct()
    checked = claims(texts).join(values, ["kind", "value"], "left").where("known IS NULL").drop("known")
    return checked.join(F.broadcast(kinds.withColumn("has", F.lit(True))), "kind", "left").where(
        (F.col("kind") == "ip") | F.col("has")
    ).drop("has")


def annotate(texts: DataFrame, known: DataFrame, max_urls: int | None = None, max_hashes: int | None = None) -> DataFrame:
    """Texts with the warning appended; it names every value unless a limit for URLs or hashes is given."""
    values = unsupported_claims(texts, known).groupBy("text_id", "kind").agg(
        F.sort_array(F.collect_set("value")).alias("v")
    )
    # output texts (fixed values)
    label = {"ip": ("IPs alucinados: ", None), "url": ("URLs alucinadas: ", max_urls), "hash": ("Hashes alucinados: ", max_hashes)}
    part: Column = F.lit(None).cast("string")
    for kind, (text, n) in label.items():
        shown = F.col("v") if n is None else F.slice("v", 1, n)
        part = F.when(F.col("kind") == kind, F.concat(F.lit(text), F.array_join(shown, ", "))).otherwise(part)
    rank = F.when(F.col("kind") == "ip", 0).when(F.col("kind") == "url", 1).otherwise(2)
    warnings = (
        values.select("text_id", F.struct(rank.alias("r"), part.alias("p")).alias("w"))
        .groupBy("text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["p"]), "; ").alias("w"))
    )
    head = (
        "\n\n> **ALERTA DE SEGURANCA (GUARDRAIL):** O modelo gerou referencias a indicadores que NAO constam "
        "no relatorio base. Desconsidere: "
    )
    return texts.join(warnings, "text_id", "left").select(
        "text_id", F.concat("text", F.coalesce(F.concat(F.lit(head), F.col("w")), F.lit(""))).alias("text")
    )


def repository_facts(findings: DataFrame, iocs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(section, repo, fact)``: one line per repository, finding and indicator."""
    s = F.lit
    na = lambda c: F.coalesce(F.col(c), s("N/A"))
    repos = scores.select(s("repository").alias("section"), "repo", F.concat(
        s("URL: "), T.scrub(F.col("repo")), s(" | Risco: "), F.col("risk_score").cast("string")).alias("fact"))
    lines = findings.select(s("finding").alias("section"), "repo", F.concat(
        s("["), na("severity"), s("] "), na("type"), s(" no arquivo "), na("file")).alias("fact"))
    vt = I.safe_get(F.col("virustotal"), I.MALICIOUS, "string", "0")
    hidden = iocs.select(s("ioc").alias("section"), "repo", F.concat(
        s("IOC Oculto: "), T.scrub(F.col("ioc")), s(" (Arquivo: "), F.col("source_file"), s(", VT: "), vt, s(")")).alias("fact"))
    return repos.unionByName(lines).unionByName(hidden)


def ip_facts(report: DataFrame) -> DataFrame:
    return report.select(F.concat(
        F.lit("IP: "), F.col("ip"), F.lit(" | VT: "), I.safe_get(F.col("virustotal"), I.MALICIOUS, "string", "N/A"),
        F.lit(" | AbuseIPDB: "), I.safe_get(F.col("abuseipdb"), "data.abuseConfidenceScore", "string", "N/A"), F.lit("%")).alias("fact"))


def url_facts(report: DataFrame) -> DataFrame:
    return report.select(F.concat(
        F.lit("URL: "), F.col("url"), F.lit(" | VT: "), I.safe_get(F.col("virustotal"), I.MALICIOUS, "string", "N/A"),
        F.lit(" | URLHaus: "), I.safe_get(F.col("urlhaus"), "url_status", "string", "N/A")).alias("fact"))


def file_facts(report: DataFrame) -> DataFrame:
    return report.select(F.concat(
        F.lit("Hash: "), F.col("sha256"), F.lit(" | Arquivo: "), F.coalesce("filename", F.lit("N/A")), F.lit(" | VT: "),
        I.safe_get(F.col("virustotal"), I.MALICIOUS, "string", "N/A"), F.lit(" | MB: "),
        I.safe_get(F.col("malwarebazaar"), "data.0.signature", "string", "N/A")).alias("fact"))


def judge_metrics(judged: DataFrame) -> DataFrame:
    """``(expected, prediction)`` in REAL / FALSO / anything else → confusion counts and scores."""
    is_ = lambda p, e: F.count_if((F.col("prediction") == p) & (F.col("expected") == e))
    counts = judged.agg(
        is_("REAL", "REAL").alias("tp"), is_("REAL", "FALSO").alias("fp"),
        is_("FALSO", "FALSO").alias("tn"), is_("FALSO", "REAL").alias("fn"), F.count("*").alias("total"),
    ).withColumn("failed", F.col("total") - F.col("tp") - F.col("fp") - F.col("tn") - F.col("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = zero(F.try_divide("tp", F.col("tp") + F.col("fp")))
    r = zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    return counts.select(
        "tp", "fp", "tn", "fn", "failed", p.alias("precision"), r.alias("recall"),
        zero(F.try_divide(2 * p * r, p + r)).alias("f1"),
    )
