"""Small helpers for literal tables and patterns."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glintscan import catalogue as K

# Unicode classes, and a dot that stops at line feed only.
FLAGS = "(?Ud)"


def remembered(make: Callable[..., Any]) -> Callable[..., Any]:
    """Keeps the columns that ``make`` builds for its arguments.

    Building a column is a call to the JVM for each of its parts. Columns that only name their inputs fit every plan, so one JVM
    needs them once; another JVM starts anew.
    """
    kept: dict[Any, Any] = {}

    @functools.wraps(make)
    def get(*args: Any) -> Any:
        key = repr(args)
        if kept.get("gateway") is not SparkContext._gateway:
            kept.clear()
            kept["gateway"] = SparkContext._gateway
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return get


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def alternation(words: list[str], prefix: str = "", suffix: str = "") -> str:
    return prefix + "(?:" + "|".join(re.escape(w) for w in words) + ")" + suffix


def contains_any(c: Column, words: list[str]) -> Column:
    return F.rlike(c, F.lit(alternation(words)))


def starts_with_any(c: Column, words: list[str]) -> Column:
    return F.rlike(c, F.lit(alternation(words, prefix="^")))


def ends_with_any(c: Column, words: list[str]) -> Column:
    return F.rlike(c, F.lit(alternation(words, suffix=r"\z")))


def blank_trim(c: Column) -> Column:
    """Trim white space as Unicode defines it."""
    return F.btrim(c, F.lit(K.BLANK_CHARS))


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed, driver-side table as a local relation (planned without a job)."""
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]

    def cell(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        return f"CAST({quote(v) if isinstance(v, str) else repr(v)} AS {t})"

    body = ", ".join("(" + ", ".join(cell(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    if not rows:
        empty = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in zip(names, types))
        return spark.sql(f"SELECT {empty} WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def lookup(c: Column, table: dict, default) -> Column:
    """Fixed dictionary look-up as one map literal."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))
