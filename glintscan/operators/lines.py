"""Lines of files with their comment state, for use on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glintscan.functions import context as X
from glintscan.operators.detect import block_state


def file_lines(files: DataFrame) -> DataFrame:
    """``files(repo, path, name, content)`` → one row per line, numbered from 0."""
    return files.select(
        "repo", F.col("path").alias("file"), X.extension(F.col("name")).alias("ext"),
        F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"),
    )


def line_gate(files: DataFrame) -> DataFrame:
    """Adds ``is_comment``, ``in_block``, ``scanned`` and the confidence ``damp`` of every line.

    The text stays behind: only numbers and markers are shuffled by file.
    """
    ext = F.col("ext")
    marked = file_lines(files).select(
        "repo", "file", "ext", "line_no", F.lit(True).alias("is_line"), F.lit("mark").alias("row_kind"),
        X.block_marker(F.col("line"), X.comment_family(ext)).alias("marker"),
        X.is_comment(F.col("line"), ext).alias("is_comment"),
    )
    scanned = ~F.col("is_comment") | F.col("in_block")
    return block_state(marked).select(
        "repo", "file", "line_no", "is_comment", "in_block", scanned.alias("scanned"),
        F.when(scanned, F.when(F.col("in_block"), 0.1).otherwise(1.0)).alias("damp"),
    )
