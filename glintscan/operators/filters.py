"""Which files of a repository are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from glintscan import catalogue as K
from glintscan.functions import context as X
from glintscan.sqltext import contains_any, ends_with_any


def list_repository(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """``listing(repo, path, type, sha)`` → files: all of them, or the first ``limit`` of each repository by path.

    A limit sorts each repository in one task; Spark cuts the ranks before the shuffle for limits up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` only.
    """
    files = listing.where("type = 'blob'").withColumn("name", X.base_name(F.col("path"))).drop("type")
    if limit is None:
        return files
    by_path = Window.partitionBy("repo").orderBy("path")
    return files.withColumn("nth", F.row_number().over(by_path)).where(F.col("nth") <= limit).drop("nth")


def _names(names: list[str], case_fix: bool) -> list[str]:
    return sorted({n.lower() for n in names}) if case_fix else names


def inspectable(files: DataFrame, case_fix: bool = False) -> DataFrame:
    """Files worth scanning.

    Names are lower-cased before they are compared with the lists as written,
    so mixed-case entries never match; ``case_fix`` compares without case.
    """
    name = F.lower("name")
    dependency = name.isin(_names(K.DEPENDENCY_FILES, case_fix))
    sensitive = name.isin(_names(K.SENSITIVE_FILENAMES, case_fix))
    interesting = ends_with_any(name, _names(K.INTERESTING_EXTENSIONS, case_fix))
    ignored = name.isin(_names(K.IGNORE_FILES, case_fix)) & ~dependency
    return files.where(
        ~contains_any(F.col("path"), K.IGNORE_DIRS) & ~ignored & (interesting | dependency | sensitive)
    )


def sensitive_files(files: DataFrame, case_fix: bool = False) -> DataFrame:
    """A review candidate for every file with a sensitive name that is not ignored."""
    name = F.lower("name")
    ignored = name.isin(_names(K.IGNORE_FILES, case_fix)) & ~name.isin(_names(K.DEPENDENCY_FILES, case_fix))
    return (
        files.where(~contains_any(F.col("path"), K.IGNORE_DIRS) & ~ignored
                    & name.isin(_names(K.SENSITIVE_FILENAMES, case_fix)))
        .select(
            "repo", F.col("path").alias("file"), F.lit("Sensitive File").alias("type"),
            F.concat(F.lit("Arquivo sensivel detectado: "), name).alias("description"),
            F.concat(F.lit("Filename: "), name).alias("match_content"),
        )
    )
