"""Dependencies meet advisories that name ranges of versions.

``ranges(ecosystem, name, introduced, fixed, id)``, with an optional ``last_affected``: a version is hit from ``introduced`` (from
the first one where that is null or ``0``) up to, not including, ``fixed``, or up to and including ``last_affected``; without either
there is no end.  A bound that is no version hits nothing.

The distinct versions in use of a package are numbered in their order, and a range becomes a stretch of these numbers.  A
stretch is the union of a few aligned blocks whose lengths are powers of two, two of each length at most, and a
number lies in one block of each length, so versions and ranges meet by equality of blocks: every pair that meets is a hit, and
no package pairs all its versions with all its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintscan.functions.versions import version_key
from glintscan.operators import lookup
from glintscan.sources.staging import stage

PACKAGE = ["ecosystem", "name"]
BOUNDS = ["introduced", "fixed", "last_affected"]
LEVELS = 31


def version_keys(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(ecosystem, text, key)`` of every version and bound that is one; each distinct text is parsed once, wherever it stands."""
    texts = versions.select("ecosystem", F.col("version").alias("text")).unionByName(
        ranges.select("ecosystem", F.explode(F.array(*[c for c in BOUNDS if c in ranges.columns])).alias("text")))
    # written before the filter, which Spark would otherwise push, and the parsing with it, below distinct()
    parsed = stage(texts.where("text IS NOT NULL").distinct().withColumn("key", version_key(F.col("ecosystem"), F.col("text"))))
    return parsed.where("key IS NOT NULL")


def _bound(ranges: DataFrame, column: str) -> tuple[Column, Column]:
    """The key of a bound, and whether it is absent."""
    if column not in ranges.columns:
        return F.lit(None).cast("string"), F.lit(True)
    return F.col(f"{column}_key"), F.col(column).isNull()


def stretches(versions: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions with their number ``nth`` in the package, and ranges as numbers ``lo`` up to, not including, ``hi``.

    One window per package passes its distinct keys and bounds in order and counts the keys before each bound.  Keys and
    bounds are needed several times and written once.
    """
    parsed = version_keys(versions, ranges)
    for c in BOUNDS:
        if c in ranges.columns:
            ranges = ranges.join(parsed.select("ecosystem", F.col("text").alias(c), F.col("key").alias(f"{c}_key")), ["ecosystem", c], "left")
    start, open_start = _bound(ranges, "introduced")
    fixed, no_fixed = _bound(ranges, "fixed")
    last, no_last = _bound(ranges, "last_affected")
    lo = F.when(open_start | (F.col("introduced") == "0"), "").otherwise(start)
    hi = F.when(~no_fixed, fixed).when(~no_last, F.concat(last, F.lit("~"))).otherwise("~")
    bounds = ranges.select(*PACKAGE, "id", lo.alias("lo"), hi.alias("hi")).where("lo IS NOT NULL AND hi IS NOT NULL AND lo < hi").distinct()
    bounds = stage(bounds)
    keyed = stage(versions.join(parsed.withColumnRenamed("text", "version"), ["ecosystem", "version"]))
    keys = keyed.select(*PACKAGE, "key").distinct().withColumn("is_key", F.lit(1))
    marks = bounds.select(*PACKAGE, F.explode(F.array("lo", "hi")).alias("key")).distinct().withColumn("is_key", F.lit(0))
    before = Window.partitionBy(*PACKAGE).orderBy("key", "is_key").rowsBetween(Window.unboundedPreceding, -1)
    numbered = keys.unionByName(marks).select("*", F.coalesce(F.sum("is_key").over(before), F.lit(0)).alias("nth"))
    at = numbered.where("is_key = 0").select(*PACKAGE, "key", "nth")
    for side in ("lo", "hi"):
        bounds = bounds.join(at.withColumnRenamed("key", side).withColumnRenamed("nth", f"{side}_nth"), [*PACKAGE, side])
    placed = keyed.join(numbered.where("is_key = 1").drop("is_key"), [*PACKAGE, "key"]).select(*PACKAGE, "version", "nth")
    return placed, bounds.select(*PACKAGE, "id", F.col("lo_nth").alias("lo"), F.col("hi_nth").alias("hi")).where("lo < hi")


def blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks ``(level, block)`` that make up the numbers from ``lo`` up to ``hi``."""
    def of_level(level: Column) -> Column:
        # at each level the inner numbers are halved; an odd start or an odd end is a block of its own
        width = F.pow(F.lit(2.0), level)
        a, b = F.ceil(lo / width).cast("bigint"), F.floor(hi / width).cast("bigint")
        first = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("block")))
        final = F.when((a < b) & (b % 2 == 1) & ~((a % 2 == 1) & (a == b - 1)), F.struct(level.alias("level"), (b - 1).alias("block")))
        return F.array(first, final)

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))
    return F.filter(every, lambda x: x.isNotNull())


def affected(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """``versions(ecosystem, name, version)`` → ``(ecosystem, name, version, id)`` of every range that holds the version."""
    placed, spans = stretches(versions.select(*PACKAGE, "version").distinct(), ranges)
    longest = spans.groupBy(*PACKAGE).agg(F.max("hi").alias("most"))
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("most"))).cast("int")))
    inside = F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor(F.col("nth") / F.pow(F.lit(2.0), k)).cast("bigint").alias("block")))
    left = placed.join(longest, PACKAGE).select(*PACKAGE, "version", F.inline(inside))
    right = spans.select(*PACKAGE, "id", F.inline(blocks(F.col("lo"), F.col("hi"))))
    return left.join(right, [*PACKAGE, "level", "block"]).select(*PACKAGE, "version", "id").distinct()


def range_findings(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings as of ``lookup.vulnerable_dependencies``, one per dependency and kind.

    The hit versions become the version list of their advisory and go the way of listed versions; a dependency without a version
    meets every advisory of its package there.  Dependencies and hits are needed several times and written once.
    """
    dependencies = stage(dependencies)
    deps = lookup.with_ecosystem(dependencies)
    hit = affected(deps.where("version <> ''"), ranges)
    named = ranges.select(*PACKAGE, F.lit(None).cast("string").alias("version"), "id").distinct()
    listed = hit.unionByName(named).groupBy(*PACKAGE, "id").agg(F.collect_list("version").alias("versions"))
    return lookup.vulnerable_dependencies(dependencies, stage(listed))
