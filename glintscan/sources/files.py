"""Directory trees and local files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glintscan import catalogue as K
from glintscan.functions.context import base_name


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
    return F.ltrim(F.replace(plain, F.lit("/" + root.strip("/")), F.lit("")), F.lit("/"))


def walkable(entries: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Skip lists of the tree walk over ``(path, length)``, and a size limit where one is given."""
    parents = F.split(F.regexp_replace("path", r"/?[^/]*\z", ""), "/")
    skipped_dir = F.arrays_overlap(parents, F.array(*[F.lit(d) for d in K.WALK_SKIP_DIRS]))
    # a leading dot alone does not start an extension
    ext = F.lower(F.regexp_extract(base_name(F.col("path")), r"(?s)^.+\.([^.]*)\z", 1))
    return within_limit(entries, max_bytes).where(~skipped_dir & ~ext.isin(K.WALK_SKIP_EXTENSIONS))


def scannable_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """All scannable files under ``root`` with metadata; a size filter reaches the source.

    Spark's listing leaves out names that start with a dot or an underscore;
    such files have to come in a table.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return walkable(listed.withColumn("path", _relative(F.col("path"), root)), max_bytes)


def decode(content: Column) -> Column:
    """UTF-8 text, with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def file_contents(entries: DataFrame, repo: str | Column) -> DataFrame:
    """``binaryFile`` rows → ``files(repo, path, name, sha, content)``."""
    repo = repo if isinstance(repo, Column) else F.lit(repo)
    return entries.select(
        repo.alias("repo"), "path", base_name(F.col("path")).alias("name"),
        F.sha2("content", 256).alias("sha"), decode(F.col("content")).alias("content"),
    )


def _size(files: DataFrame) -> Column:
    return F.col("length") if "length" in files.columns else F.octet_length("content")


def within_limit(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """Files up to ``max_bytes``; all without a limit."""
    return files if max_bytes is None else files.where(_size(files) <= max_bytes)


def oversized(files: DataFrame, max_bytes: int) -> DataFrame:
    """The files that a limit leaves out, without their content."""
    return files.where(_size(files) > max_bytes).drop("content")


def file_hashes(entries: DataFrame) -> DataFrame:
    """One row per SHA-256 with the last file name; ``entries(path, content)``."""
    return entries.groupBy(F.sha2("content", 256).alias("sha256")).agg(
        F.max_by(base_name(F.col("path")), F.col("path")).alias("filename")
    )
