"""Dependencies meet advisories, indicators meet intelligence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glintscan import catalogue as K
from glintscan.sources.staging import stage
from glintscan.sqltext import literal_table


def with_ecosystem(dependencies: DataFrame) -> DataFrame:
    """Adds the package ecosystem of the manifest; manifests without one drop out."""
    table = literal_table(dependencies.sparkSession, list(K.ECOSYSTEMS.items()), "manifest STRING, ecosystem STRING")
    return dependencies.join(F.broadcast(table), "manifest")


def vulnerable_dependencies(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """``advisories(ecosystem, name, versions, id)`` → findings, one per dependency and kind.

    Distinct packages are looked up once; a dependency without a version meets
    every advisory of its package.  Spark splits popular packages when the
    result goes back to the rows that use them.  The dependencies are needed
    three times and written once, so manifests are parsed once.
    """
    deps = stage(with_ecosystem(dependencies).select("repo", "manifest", "ecosystem", "name", "version").distinct())
    wanted = deps.select("ecosystem", "name", "version").distinct()
    malicious = F.startswith("id", F.lit("MAL-"))
    # equal versions meet by key, so a package never pairs all its versions with all its advisories
    by_version = advisories.select("ecosystem", "name", F.explode("versions").alias("version"), "id")
    versioned = wanted.where("version <> ''").join(by_version, ["ecosystem", "name", "version"])
    unversioned = wanted.where("version = ''").join(advisories.select("ecosystem", "name", "id"), ["ecosystem", "name"])
    found = (
        versioned.unionByName(unversioned)
        .groupBy("ecosystem", "name", "version")
        .agg(F.sort_array(F.collect_set(F.when(malicious, F.col("id")))).alias("mal"),
             F.sort_array(F.collect_set(F.when(~malicious, F.col("id")))).alias("vul"))
    )

    def kind(label: str, ftype: str, ids: str):
        text = F.concat(F.lit(f"{label}: '"), F.col("name"), F.lit("' (IDs: "), F.array_join(ids, ", "), F.lit(")"))
        return F.when(F.size(ids) > 0, F.struct(
            F.lit(ftype).alias("type"), text.alias("description"), F.lit(K.SEVERITY[ftype]).alias("severity")))

    findings = F.array(
        kind("Dependencia maliciosa", "Malicious Dependency", "mal"),
        kind("Dependencia vulneravel", "Vulnerable Dependency", "vul"),
    )
    return (
        deps.join(found, ["ecosystem", "name", "version"])
        .select("repo", F.col("manifest").alias("file"), F.inline(F.filter(findings, lambda f: f.isNotNull())))
        .distinct()
    )


# Output texts (fixed values).
SKIPPED = "Ignorado (Limite de Performance)"
FAILED = "Falha na verificacao"


def one_report(reports: DataFrame, key: str, latest_by: str | None = None) -> DataFrame:
    """One row per ``key``: the report with the greatest ``latest_by``, or of equal standing the greatest JSON text."""
    values = [c for c in reports.columns if c not in (key, latest_by)]
    rank = F.struct(*([latest_by] if latest_by else []), *[F.to_json(F.col(c)).alias(f"j{i}") for i, c in enumerate(values)])
    best = reports.groupBy(key).agg(F.max_by(F.struct(*values), rank).alias("r"))
    return best.select(key, "r.*")


def ioc_reputation(iocs: DataFrame, intel: DataFrame, limit: int | None = None, latest_by: str | None = None) -> DataFrame:
    """Adds ``virustotal``, ``urlhaus`` and ``lookup`` to every indicator row.

    ``lookup`` is ``ok``, ``missing`` (no report), the text for failed look-ups (a report row whose sources are both
    null), or the text for skipped rows.  Nothing is skipped unless ``limit`` is given: then only the first
    ``limit`` distinct indicators of each repository count, and the last of them is carried back, so no repository is gathered whole.
    Of several reports on one indicator, ``one_report`` chooses.
    """
    columns = ["url", "virustotal", "urlhaus", *([latest_by] if latest_by else [])]
    reports = one_report(intel.select(*columns), "url", latest_by).withColumnRenamed("url", "ioc").withColumn("known", F.lit(True))
    checked = F.lit(True)
    marked = iocs
    if limit is not None:
        first = Window.partitionBy("repo").orderBy("ioc")
        top = iocs.select("repo", "ioc").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
        marked = iocs.join(top.groupBy("repo").agg(F.max("ioc").alias("last_ioc")), "repo", "left")
        checked = F.col("ioc") <= F.col("last_ioc")
    looked = marked.join(reports, "ioc", "left")
    failed = F.col("virustotal").isNull() & F.col("urlhaus").isNull()
    return looked.select(
        *iocs.columns,
        F.when(checked, F.col("virustotal")).alias("virustotal"),
        F.when(checked, F.col("urlhaus")).alias("urlhaus"),
        F.when(~checked, SKIPPED).when(F.col("known") & failed, FAILED).when(F.col("known"), "ok").otherwise("missing").alias("lookup"),
    )


def ioc_limit_notes(iocs: DataFrame, limit: int) -> DataFrame:
    """One finding for every repository with more distinct indicators than ``limit``, where a caller sets one."""
    n = F.col("n").cast("string")
    return (
        iocs.select("repo", "ioc").distinct().groupBy("repo").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        .select(
            "repo", F.lit("MEDIUM").alias("severity"),
            F.concat(F.lit("Limite de IOCs atingido ("), n,
                     F.lit(f"). Analisando amostra de {limit} para performance.")).alias("description"),
            F.lit("Sistema").alias("file"), F.lit("Performance Limit").alias("type"),
        )
    )


def distinct_ioc_counts(iocs: DataFrame) -> DataFrame:
    return iocs.select("repo", "ioc").distinct().groupBy("repo").agg(F.count("*").alias("distinct_iocs"))


def merge_sources(targets: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """One column per source; ``sources[name]`` is ``(key, report)``, a missing report is NULL, of several one counts."""
    out = targets
    for name, reports in sources.items():
        out = out.join(one_report(reports.select(key, F.col("report").alias(name)), key), key, "left")
    return out
