"""Repository analysis: scan, incremental re-scan, enrichment, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from glintscan import catalogue as K
from glintscan.catalogue import Rule
from glintscan.operators import correlate, dedup, detect, filters, lookup, manifests, score, triage, verdict
from glintscan.sources import snapshots, staging, state as S
from glintscan.sources.files import within_limit

STATE_FINDING = [
    "type", "description", "match_content", "confidence", "file_context", "severity", "disposition", *detect.SEQUENCE,
]
STATE_IOC = ["ioc", *detect.SEQUENCE]


def scan(files: DataFrame, rules: Sequence[Rule] | None = None, partitions: int | None = None,
         max_bytes: int | None = None) -> DataFrame:
    """Findings and indicators of ``files(repo, path, name, content)``, all of them unless ``max_bytes`` is given.

    The files are scanned in the partitions they come in.  ``partitions`` deals their content out anew, which pays for a
    small input in a few large pieces; ``sources.files.oversized`` lists what a size limit leaves out.
    """
    columns = within_limit(files.select("repo", "path", "name", "content"), max_bytes)
    return detect.hits(columns if partitions is None else columns.repartition(partitions, "repo", "path"), rules)


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose content hash is new or different; ``files`` need ``sha``.

    The comparison reads keys and hashes only.  Content is then picked by the
    changed keys, which are broadcast when they turn out to be few.
    """
    hashed = files.withColumn("_sha", F.coalesce("sha", F.lit("")))  # a file without a hash is new unless the state has it so
    old = state.select("repo", "path", F.coalesce("content_hash", F.lit("")).alias("_sha"))
    changed = hashed.select("repo", "path", "_sha").join(old, ["repo", "path", "_sha"], "left_anti")
    return hashed.join(changed, ["repo", "path", "_sha"], "left_semi").select(*files.columns)


def unchanged_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """State rows of files that are still there as they were."""
    now = files.select("repo", "path", F.coalesce("sha", F.lit("")).alias("_sha"))
    known = state.withColumn("_sha", F.coalesce("content_hash", F.lit("")))
    return known.join(now, ["repo", "path", "_sha"], "left_semi").select(*state.columns)


def scanned_state(files: DataFrame, rules: Sequence[Rule] | None = None, case_fix: bool = False,
                  severity: dict[str, str] | None = None) -> DataFrame:
    """Scan ``files(repo, path, name, sha, content)`` into state rows.

    One row per version of a file (repo, path, hash) with its findings, indicators and dependencies: every
    list is limited by the size of the file.  Review candidates are stored
    too, with their disposition.  Files without hits keep a row with their hash.

    The content is read once: what scan and manifests need of it (lines and tokens that may be hits, and the manifests)
    is written to the shared folder first, and both go on from there.
    """
    # the hash travels in front of the repository, so that it is in the key of every branch
    files = files.withColumn("repo", F.concat_ws("\n", F.coalesce("sha", F.lit("")), F.coalesce("repo", F.lit(""))))
    chosen = filters.inspectable(files, case_fix)
    no_finding, no_ioc = F.lit(None).cast(S.FINDING), F.lit(None).cast(S.IOC)
    no_dependency = F.lit(None).cast(S.DEPENDENCY)

    def part(df: DataFrame, path: str, finding, ioc, dependency) -> DataFrame:
        return df.select("repo", F.col(path).alias("path"),
                         finding.alias("finding"), ioc.alias("ioc"), dependency.alias("dependency"))

    def finding(df: DataFrame):
        return F.struct(*[
            (F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in STATE_FINDING]).cast(S.FINDING)

    rules = K.shipped_rules() if rules is None else detect.compile_rules(rules)
    cands = staging.stage(detect.candidates(chosen, rules, manifests.NAMES))
    hits = triage.triage(detect.hits_of(cands, rules), severity).withColumn("ioc", F.col("match_content"))
    is_ioc = F.col("row_kind") == "ioc"
    from_hits = part(
        hits.where(is_ioc | (F.col("disposition") != "discard")), "file",
        F.when(~is_ioc, finding(hits)), F.when(is_ioc, F.struct(*STATE_IOC).cast(S.IOC)), no_dependency,
    )
    wholes = cands.where("kind = 'whole'").select("repo", "path", "name", F.col("txt").alias("content"))
    manifest = manifests.manifest_rows(wholes).withColumn(
        "hook", F.explode_outer(F.when(F.col("kind") == "script", manifests.hook_findings()))
    ).select("*", "hook.*").withColumn("disposition", F.lit("accept"))
    from_manifests = part(
        manifest.where("kind = 'package' OR hook IS NOT NULL"), "path",
        F.when(F.col("hook").isNotNull(), finding(manifest)), no_ioc,
        F.when(F.col("kind") == "package", F.struct("manifest", "name", "version").cast(S.DEPENDENCY)),
    )
    sensitive = filters.sensitive_files(files, case_fix).select(
        "*", F.lit("LOW").alias("severity"), F.lit("candidate").alias("disposition"))
    from_names = part(sensitive, "file", finding(sensitive), no_ioc, no_dependency)
    keys = files.select("repo", "path", no_finding.alias("finding"), no_ioc.alias("ioc"), no_dependency.alias("dependency"))
    rows = keys.unionByName(from_hits).unionByName(from_manifests).unionByName(from_names)
    state = rows.groupBy("repo", "path").agg(
        F.collect_list("finding").alias("findings"),
        F.collect_list("ioc").alias("iocs"), F.collect_list("dependency").alias("dependencies"),
    )
    both = F.split("repo", "\n", 2)
    return state.select("path", both[0].alias("content_hash"), "findings", "iocs", "dependencies", both[1].alias("repo"))


def rescan(files: DataFrame, state: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The next snapshot: unchanged files keep their rows, the others are scanned again."""
    fresh = scanned_state(changed_files(files, state), rules)
    return unchanged_state(files, state).unionByName(fresh)


def apply_changes(state: DataFrame, changes: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The next snapshot from a feed of changes (``repo``, ``path``, ``name``, ``sha``, ``content``, ``deleted``, ``seq``).

    A tombstone (``deleted``) removes the file, any other change replaces what the state holds of it; of several changes of a file
    the one with the greatest ``seq`` counts. Files that no change names keep their rows, and their content is not read.
    """
    newest = snapshots.newest_changes(changes)
    gone = newest.select("repo", "path").distinct()
    fresh = scanned_state(newest.where("NOT coalesce(deleted, false)").drop("deleted", "seq"), rules)
    return state.join(gone, ["repo", "path"], "left_anti").unionByName(fresh)


def findings_of(state: DataFrame) -> DataFrame:
    return state.select("repo", F.col("path").alias("file"), F.inline("findings"))


def iocs_of(state: DataFrame) -> DataFrame:
    return state.select("repo", F.col("path").alias("source_file"), F.inline("iocs"))


def dependencies_of(state: DataFrame) -> DataFrame:
    return state.select("repo", "path", F.inline("dependencies"))


def analyse(state: DataFrame, advisories: DataFrame | None = None, intel: DataFrame | None = None,
            verdicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Enrich a written snapshot: findings, iocs, dependencies and scores per repository.

    Read ``state`` from the written table, so that the scan is not repeated by
    every result.  Findings with their correlation are written to the shared folder once, since three results need them.
    """
    found = findings_of(state)
    base = triage.accepted(found)
    candidates = triage.review_candidates(found)
    iocs = iocs_of(state)
    deps = manifests.merged_dependencies(dependencies_of(state))
    extra = [verdict.apply_verdicts(candidates, verdicts)]
    if advisories is not None:
        extra.append(lookup.vulnerable_dependencies(deps, advisories))
    if intel is not None:
        iocs = lookup.ioc_reputation(iocs, intel)
    findings = base
    for e in extra:
        findings = findings.unionByName(e, allowMissingColumns=True)
    findings = staging.stage(correlate.correlate(findings, iocs))
    unique = dedup.deduplicate(findings)
    return {
        "findings": unique, "locations": dedup.finding_locations(findings), "iocs": iocs, "dependencies": deps,
        "scores": score.risk_scores(unique, state),
    }
