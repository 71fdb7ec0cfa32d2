"""Huge files as parts: runs of whole lines that different tasks can scan.

A part is a row ``(repo, path, name, part, first_line, content)``.  ``part`` is the offset of its first character in the file
and ``first_line`` the number of its first line; the line feed between two parts belongs to neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glintscan.functions.context import base_name
from glintscan.sources.files import _relative

PART_CHARS = 1 << 20


def cut_files(files: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``files(repo, path, name, content)`` → parts of at least ``part_chars`` characters, ended by the next line end.

    The parts of one row are made by one task; deal them out with ``repartition`` where a few rows are huge.  A null
    content gives no part, an empty one gives none either.
    """
    runs = F.regexp_extract_all("content", F.lit(rf"(?s)\G(.{{1,{part_chars}}}[^\n]*)(?:\n|\z)"), F.lit(1))
    total = lambda counts, n: F.aggregate(F.slice(counts, 1, n), F.lit(0).cast("bigint"), lambda a, v: a + v)
    cut = files.select("repo", "path", "name", runs.alias("runs")).select(
        "*", F.transform("runs", lambda r: F.size(F.split(r, "\n"))).alias("lines"),
        F.transform("runs", lambda r: F.char_length(r) + 1).alias("chars"))
    return cut.select("repo", "path", "name", F.inline(F.transform("runs", lambda r, i: F.struct(
        total(F.col("chars"), i).alias("part"), total(F.col("lines"), i).alias("first_line"), r.alias("content")))))


def read_parts(spark: SparkSession, root: str, repo: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Text files under ``root`` as parts, each file read by as many tasks as it has blocks.

    The text source cuts a file at line starts every ``spark.sql.files.maxPartitionBytes``.  Lines are numbered inside their
    block; only the line and character counts of the blocks, one row each, are summed over a whole file.  A line longer
    than a block stays whole, with the block in which it starts.  A line feed at the very end of a file is dropped.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(root).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.make_valid_utf8("value").alias("value"))
    lines = lines.withColumn("chars", F.char_length("value") + 1)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("source", "block").agg(F.count("*").alias("lines"), F.sum("chars").alias("chars")).select(
        "source", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("line_base"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_base"))
    in_block = Window.partitionBy("source", "block").orderBy("id")
    numbered = lines.select("source", "block", "id", "value", (F.sum("chars").over(in_block) - F.col("chars")).alias("at"),
                            (F.row_number().over(in_block) - 1).alias("nth"))
    runs = numbered.groupBy("source", "block", F.floor(F.col("at") / part_chars).alias("run")).agg(
        F.min("at").alias("at"), F.min("nth").alias("nth"), F.sort_array(F.collect_list(F.struct("id", "value"))).alias("rows"))
    path = _relative(F.col("source"), root)
    return runs.join(starts, ["source", "block"]).select(
        F.lit(repo).alias("repo"), path.alias("path"), base_name(path).alias("name"), (F.col("char_base") + F.col("at")).alias("part"),
        (F.col("line_base") + F.col("nth")).alias("first_line"), F.array_join(F.col("rows.value"), "\n").alias("content"))
