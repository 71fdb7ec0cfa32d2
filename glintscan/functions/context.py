"""What kind of file is this: extension, context, comment syntax."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glintscan import catalogue as K
from glintscan.sqltext import blank_trim, contains_any, ends_with_any, lookup, starts_with_any


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text after the last dot, lower-cased; a name without a dot is its own extension."""
    return F.lower(F.substring_index(name, ".", -1))


def file_context(path: Column) -> Column:
    p = F.concat(F.lit("/"), F.lower(path))
    n = base_name(p)
    return (
        F.when(
            contains_any(p, K.TEST_DIRS)
            | starts_with_any(n, K.TEST_PREFIXES)
            | ends_with_any(n, K.TEST_SUFFIXES),
            "Test",
        )
        .when(contains_any(p, K.EXAMPLE_DIRS), "Example")
        .when(contains_any(n, K.TEMPLATE_PARTS), "Template")
        .when(
            contains_any(p, K.DOC_DIRS) | ends_with_any(n, K.DOC_SUFFIXES) | (n == "readme"),
            "Documentation",
        )
        .otherwise("Production")
    )


def context_multiplier(context: Column) -> Column:
    return lookup(context, K.CONTEXT_MULTIPLIER, 1.0)


def is_safe_context(path: Column, ext: Column) -> Column:
    """Files in which suspicious commands are not reported."""
    return ext.isin(K.SAFE_EXTENSIONS) | contains_any(F.lower(path), K.SAFE_PATH_PARTS)


def is_comment(line: Column, ext: Column) -> Column:
    t = blank_trim(line)
    return (
        F.when(t == "", True)
        .when(ext.isin(K.HASH_COMMENT_EXTENSIONS), F.startswith(t, F.lit("#")))
        .when(
            ext.isin(K.SLASH_COMMENT_EXTENSIONS),
            F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("*")) | F.startswith(t, F.lit("/*")),
        )
        .when(ext == "sql", F.startswith(t, F.lit("--")))
        .otherwise(False)
    )


def comment_family(ext: Column) -> Column:
    """Which block-comment syntax applies: ``c``, ``py`` or none."""
    return F.when(ext.isin(K.BLOCK_COMMENT_EXTENSIONS), "c").when(ext == "py", "py")


def block_marker(line: Column, family: Column) -> Column:
    """The effect of one line on the block-comment state.

    C family: ``C`` closes, ``O`` opens without closing.  Python: ``S`` is a
    docstring that ends on its own line, ``T`` toggles.  Other lines: NULL.
    """
    quotes = rf"^[{K.BLANK}]*+(?:\"\"\"|''')"
    closed = rf"^[{K.BLANK}]*+(?:\"\"\"(?s:.*)\"\"\"|'''(?s:.*)''')"
    return F.when(
        family == "c",
        F.when(F.contains(line, F.lit("*/")), "C").when(F.contains(line, F.lit("/*")), "O"),
    ).when(
        family == "py",
        F.when(F.rlike(line, F.lit(closed)), "S").when(F.rlike(line, F.lit(quotes)), "T"),
    )


def is_import_or_log(line: Column) -> Column:
    """Lines on which suspicious rules stay silent."""
    t = blank_trim(line)
    return (
        F.startswith(t, F.lit("import "))
        | F.startswith(t, F.lit("from "))
        | F.contains(t, F.lit("console.log"))
    )


