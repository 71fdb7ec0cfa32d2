"""Target lists: addresses, URLs and repositories, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glintscan.sqltext import blank_trim


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _entry(line: Column) -> Column:
    return blank_trim(F.split_part(line, F.lit("#"), F.lit(1)))


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"


def is_ipv4(s: Column) -> Column:
    return F.rlike(s, F.lit(rf"^{IPV4}\z"))


def is_ipv6(s: Column) -> Column:
    """Eight groups, or fewer around one ``::``; the tail may be dotted, a zone may follow."""
    plain = F.regexp_replace(s, r"%[^%]+\z", "")
    plain = F.regexp_replace(plain, rf"(?<=:){IPV4}\z", "0:0")
    groups = F.size(F.regexp_extract_all(plain, F.lit("[0-9a-fA-F]+"), F.lit(0)))
    full = F.rlike(plain, F.lit(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\z"))
    g = "[0-9a-fA-F]{1,4}"
    short = F.rlike(plain, F.lit(rf"^(?:{g}(?::{g}){{0,6}})?::(?:{g}(?::{g}){{0,6}})?\z")) & (groups <= 7)
    return full | short


HOSTNAME = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)++[a-zA-Z]{2,}\z"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)(?::[^/?#]*)?(?:[/?#]|\z)"


def classify_targets(lines: DataFrame) -> DataFrame:
    """``(kind, target)``: kind is ``ip``, ``url`` or ``rejected``; blank and comment lines drop out."""
    entry = F.col("entry")
    url = F.when(F.contains(entry, F.lit("://")), entry).otherwise(F.concat(F.lit("https://"), entry))
    ip = is_ipv4(entry) | is_ipv6(entry)
    named = F.rlike(F.regexp_extract(url, AUTHORITY, 1), F.lit(HOSTNAME))
    return (
        lines.select(_entry(F.col("line")).alias("entry")).where("entry <> ''")
        .select(F.when(ip, "ip").when(named, "url").otherwise("rejected").alias("kind"),
                F.when(~ip & named, url).otherwise(entry).alias("target"))
    )


def parse_targets(lines: DataFrame) -> DataFrame:
    """Distinct valid targets in order."""
    return classify_targets(lines).where("kind <> 'rejected'").distinct().orderBy("kind", "target")


FULL_REPO = r"(?iU)^(?:https?://)?(?:www\.)?(github\.com|gitlab\.com)/([\w.-]+/[\w.-]+[/\w.-]*)"
SHORT_REPO = r"(?U)^([\w.-]+/[\w.-]+)\z"


def parse_repositories(lines: DataFrame) -> DataFrame:
    """``lines(line_no, line)`` → ``(status, value, n)``: valid URLs, invalid entries, duplicate entries.

    Ordered by status; valid and duplicate ones by value, invalid ones as they were listed.

    Repeats of an entry are folded before the shuffle, so the window by URL sees
    only its different spellings.  Invalid entries keep their repeats in ``n``.
    """
    entry = F.col("entry")
    host = F.lower(F.regexp_extract(entry, FULL_REPO, 1))
    path = F.regexp_replace(F.regexp_extract(entry, FULL_REPO, 2), r"\.git\z", "")
    url = F.when(host != "", F.concat(F.lit("https://"), host, F.lit("/"), path)).when(
        F.rlike(entry, F.lit(SHORT_REPO)), F.concat(F.lit("https://github.com/"), entry))
    spelled = (
        lines.select("line_no", _entry(F.col("line")).alias("entry")).where("entry <> ''")
        .withColumn("url", url)
        .groupBy("url", "entry").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    )
    known = spelled.where("url IS NOT NULL")
    same = Window.partitionBy(F.lower("url")).orderBy("line_no")
    ranked = known.withColumn("nth", F.row_number().over(same))
    status = (
        F.when((F.col("nth") == 1) & (F.col("n") > 1), F.array(F.lit("valid"), F.lit("duplicate")))
        .when(F.col("nth") == 1, F.array(F.lit("valid"))).otherwise(F.array(F.lit("duplicate")))
    )
    listed = ranked.select("url", "entry", F.explode(status).alias("status")).select(
        "status", F.when(F.col("status") == "valid", F.col("url")).otherwise(F.col("entry")).alias("value"),
        F.lit(1).cast("bigint").alias("n"), F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"),
    )
    invalid = spelled.where("url IS NULL").select(F.lit("invalid").alias("status"), F.col("entry").alias("value"), "n", "line_no")
    return listed.unionByName(invalid).orderBy("status", "line_no", "value").drop("line_no")
