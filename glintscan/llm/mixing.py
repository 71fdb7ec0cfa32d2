"""Mixing sources to target weights by thresholds on a hash of the documents.

Every document has a 63-bit hash, its place. For each source and budget there is one threshold: documents up to it
are taken. It is found from histograms, never by sorting: sizes are summed by source and hash bucket, the bucket
where the budget runs out is the boundary, and only its documents go to the next, finer histogram. A larger budget
has a larger threshold, so mixes are nested. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, same, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Bits of the place that each round of histograms resolves; together 63.
ROUND_BITS = (13, 13, 13, 12, 12)
EVERYTHING = 2**63 - 1


def word_count(docs: DataFrame) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")


def place(docs: DataFrame) -> Column:
    """63 bits that depend on id and text only, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), docs["doc_id"], docs["text"]), 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from one row per source.

    Sources by code point, null last, have the weights in turn. Together they get ``share`` of all sizes by weight;
    a target stops at ``max_repeats`` times its source's size and the excess is shared again. That ends at the level
    where the capped sources are those with the smallest size per unit of weight, so cumulated sums find it.
    The windows hold one row per source, a table of weights; documents are summed before.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.array(*map(F.lit, weights))[F.col("turn")])
        .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * share)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        # The first source that stays under its cap if all before it are capped; those after it stay too.
        .withColumn("stays", F.col("left") * F.col("weight") / F.col("open") <= F.col("cap"))
        .withColumn("first", F.first(F.when(F.col("stays"), F.struct("left", "open")), ignorenulls=True)
                    .over(by_need.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("first.left") * F.col("weight") / F.col("first.open")))
    return levels.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The greatest place that each budget takes: ``source``, ``level``, ``limit``.

    ``rows``: ``source``, ``size``, ``place``. ``budgets``: ``source``, ``level`` (any key), ``budget``.
    Rows of one place are taken together or left together, whichever comes nearer to the budget.
    """
    found, open_, shift = None, None, 63
    for bits in ROUND_BITS:
        near = rows
        if open_ is not None:
            inside = rows.withColumn("prefix", F.shiftright("place", shift))
            near = inside.join(open_, same(inside, open_, "source") & (inside["prefix"] == open_["prefix"])).select(
                inside["source"], "level", "left", "place", "size")
        shift -= bits
        keys = ["source"] if open_ is None else ["source", "level", "left"]
        sums = near.groupBy(*keys, F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("place").alias("bottom"), F.max("place").alias("top"))
        if open_ is None:
            sums, all_budgets = staged(sums), budgets.withColumn("left", F.col("budget").cast("double"))
            sums = all_budgets.join(sums, same(all_budgets, sums, "source")).select(
                all_budgets["source"], "level", "left", "bucket", "size", "bottom", "top")
        by_bucket = Window.partitionBy("source", "level").orderBy("bucket")  # 8,192 rows at most
        best = staged(
            sums.withColumn("upto", F.sum("size").over(by_bucket)).groupBy("source", "level", "left")
            .agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "size", "bottom", "top"))).alias("b"))
            .withColumn("left", F.col("left") - F.coalesce(F.col("b.upto") - F.col("b.size"), F.lit(0))))
        one_place = F.col("b.top") == F.col("b.bottom")
        taken = F.when(F.col("b").isNull(), F.lit(EVERYTHING)).when(F.col("left") * 2 >= F.col("b.size"), F.col("b.top")).otherwise(F.col("b.bottom") - 1)
        ended = best.filter(F.col("b").isNull() | one_place).select("source", "level", taken.alias("limit"))
        found = ended if found is None else found.unionByName(ended)
        open_ = best.filter(~one_place).select("source", "level", "left", F.col("b.bucket").alias("prefix"))
        if open_.isEmpty():
            break
    return found


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out``: ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` has ``doc_id``, ``source`` and ``text``. The size is the number of words (null text: 0); a null source
    is a source of its own. ``copies`` is how often the mix takes the document, ``taken`` the words this makes.
    Equal rows share their place, so they are taken alike. An empty table gives an empty table. Sources without
    words have the target 0. A column named ``out`` is replaced.
    """
    rows = staged(docs.select("source", word_count(docs).alias("size"), place(docs).alias("place")))
    sources = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    repeat = F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("level")
    budgets = sources.select("source", "source_size", "target", repeat).select(
        "source", "level", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - (F.col("level") - 1) * F.col("source_size"))).alias("budget"))
    limits = thresholds(rows, budgets).groupBy("source").agg(F.collect_list("limit").alias("mix_limits"))  # max_repeats of them
    limits = staged(sources.join(limits, same(sources, limits, "source"), "left").select(
        sources["source"].alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "mix_limits"))
    joined = docs.join(limits, docs["source"].eqNullSafe(limits["mix_source"]), "left")
    here = place(docs)
    copies = F.size(F.filter(F.col("mix_limits"), lambda limit: here <= limit))
    size = word_count(docs)
    made = F.struct(size.alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                    copies.alias("copies"), (size * copies).alias("taken"))
    kept = [docs[c] for c in docs.columns if c.lower() != out.lower()]
    return joined.select(*kept, made.alias(out))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    rows = mix(docs, out="mix_of_document")
    return rows.filter("mix_of_document.copies > 0").withColumn("mix_of_document", F.explode(F.sequence(F.lit(1), F.col("mix_of_document.copies")))).drop("mix_of_document")
