"""Review candidates meet verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintscan.functions import confidence as C

RANK = ["file", "stage", "line_no", "pos", "rule_no", "match_no", "type", "description"]


def parse_verdict(payload: Column) -> Column:
    """``struct(verdict, score)`` from a free-text answer holding one JSON object."""
    doc = F.try_parse_json(F.regexp_extract(payload, r"(?s)\{.*\}", 0))
    raw = F.try_variant_get(doc, "$.score", "variant")
    number = F.try_variant_get(doc, "$.score", "double")
    score = F.when(number.isNotNull(), C.clamp(number))
    status = F.upper(F.coalesce(F.try_variant_get(doc, "$.status", "string"), F.lit("")))
    named = lambda v, s: F.struct(F.lit(v).alias("verdict"), (s if isinstance(s, Column) else F.lit(s)).alias("score"))
    return (
        F.when(payload.isNull() | doc.isNull() | (raw.isNotNull() & score.isNull()), named("FALHA", 0.5))
        .when(raw.isNotNull(), F.when(score >= 0.6, named("REAL", score)).when(score <= 0.3, named("FALSO", score))
              .otherwise(named("INCONCLUSIVO", score)))
        .when(status == "REAL", named("REAL", 0.8))
        .when(status == "FALSO", named("FALSO", 0.2))
        .otherwise(named("INCONCLUSIVO", 0.5))
    )


def with_rank_cut(candidates: DataFrame, limit: int) -> DataFrame:
    """Adds ``checked`` (among the first ``limit`` of its repository) and ``total``; every candidate is compared with the last such rank."""
    rank = F.struct(*[c for c in RANK if c in candidates.columns])
    first = (
        candidates.select("repo", rank.alias("rank"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("rank")))
        .where(F.col("nth") <= limit)
        .groupBy("repo").agg(F.max("rank").alias("last_rank"))
    )
    cut = candidates.groupBy("repo").agg(F.count("*").alias("total")).join(first, "repo")
    return candidates.join(cut, "repo", "left").withColumn("checked", rank <= F.col("last_rank")).drop("last_rank")


def answers_by_candidate(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One answer per key: the one with the highest score, so that a confirmation is never lost to another answer."""
    v = parse_verdict(F.col("payload"))
    best = F.max_by(F.col("v"), F.struct(F.col("v.score"), F.col("v.verdict")))
    return verdicts.withColumn("v", v).groupBy(*keys).agg(best.alias("v"), F.count("*").alias("answers"))


def _has(c: Column, *words: str) -> Column:
    return F.rlike(c, F.lit("|".join(words)))


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Candidates → findings ``(repo, severity, description, file, type)``.

    ``verdicts`` holds a ``payload`` for ``repo``, ``file``, ``type`` and any of the columns of ``RANK`` that tell candidates
    of one file and type apart: each candidate gets the answer to itself.  Without any verdicts, the checked candidates stay as weak
    findings.  All are checked unless ``limit`` is given: then candidates beyond it ask for a manual check, and
    their repository gets one note about it.
    """
    ranked = with_rank_cut(candidates, limit) if limit is not None else candidates.withColumn("checked", F.lit(True))
    ftype, text = F.col("type"), F.col("description")
    # output texts (fixed values)
    unverified = F.concat(F.lit("UNVERIFIED ("), ftype, F.lit(")"))

    def finding(severity, description, kind) -> Column:
        return F.struct(severity.alias("severity"), description.alias("description"), F.col("file").alias("file"), kind.alias("type"))

    manual = finding(
        F.when(_has(ftype, "Key", "Token", "Secret"), "HIGH").otherwise("MEDIUM"),
        F.concat(F.lit("[CHECAGEM MANUAL] "), text), unverified,
    )
    if verdicts is None:
        out = F.when(~F.col("checked"), manual).otherwise(finding(F.lit("LOW"), text, ftype))
    else:
        keys = ["repo", "file", "type", *[c for c in RANK if c not in ("file", "type") and c in verdicts.columns and c in candidates.columns]]
        ranked = ranked.join(answers_by_candidate(verdicts, keys), keys, "left").withColumn(
            "v", F.coalesce("v", parse_verdict(F.lit(None).cast("string"))))
        out = (
            F.when(~F.col("checked"), manual)
            .when(F.col("v.verdict") == "REAL", finding(
                F.when(_has(ftype, "Key", "Token"), "HIGH").otherwise("MEDIUM"),
                F.concat(F.lit("[IA Confirmou] "), text), ftype))
            .when(F.col("v.verdict") != "FALSO", finding(
                F.lit("MEDIUM"), F.concat(F.lit("[IA Inconclusiva] "), text), unverified))
        )
    judged = ranked.select("repo", out.alias("f")).where("f IS NOT NULL").select("repo", "f.*")
    if limit is None:
        return judged.dropDuplicates(["repo", "type", "file", "description"])
    over = candidates.groupBy("repo").agg(F.count("*").alias("total")).where(F.col("total") > limit)
    note = over.select(
        "repo", F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Limite de IA atingido. "), (F.col("total") - limit).cast("string"),
                 F.lit(" itens requerem revisao manual.")).alias("description"),
        F.lit("Sistema").alias("file"), F.lit("Performance Limit").alias("type"),
    )
    return judged.unionByName(note).dropDuplicates(["repo", "type", "file", "description"])
