"""The scan over parts of files: a huge file is the work of many tasks.

A part is scanned like a file of its own.  What crosses its borders is little: the block-comment state and a character array
that goes on in the next part.  Every part tells its effect on the comment state as a summary (last marker, does a one-line
docstring reset it, odd number of toggles since), and summaries compose: a running window over one row per part gives the
state in which each part begins.  No task holds the hits of a whole file at once, except those of one kind that
are first in their part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintscan import catalogue as K
from glintscan.catalogue import Rule
from glintscan.functions import context as X
from glintscan.operators import detect as D
from glintscan.sources.staging import stage

CODES = rf"[0-9,{K.BLANK}]"
EDGES = ["head", "through", "tail"]


def _edge(kind: str, text: Column) -> Column:
    """A piece of a character array, or NULL in its place when a code between two commas is none."""
    cells = F.split(text, ",")
    inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
    fine = F.forall(inner, lambda c: F.rlike(X.blank_trim(c), F.lit(r"^[0-9]{2,3}\z")))
    return F.struct(F.lit(kind).alias("kind"), F.char_length("content").alias("pos"),
                    F.lit(None).cast("string").alias("marker"), F.when(fine, text).alias("txt"))


def edge_tokens() -> Column:
    """Where a character array may enter, cross or leave the part."""
    c, none = F.col("content"), F.array().cast(D.TOKEN)
    head = F.regexp_extract(c, rf"^({CODES}*+)\]", 1)
    tail = F.regexp_extract(c, rf"\[({CODES}*+)\z", 1)
    return F.concat(
        F.when(F.rlike(c, F.lit(rf"^{CODES}*+\]")), F.array(_edge("head", head))).otherwise(none),
        F.when(F.rlike(c, F.lit(rf"^{CODES}*+\z")), F.array(_edge("through", c))).otherwise(none),
        F.when(F.rlike(c, F.lit(rf"\[{CODES}*+\z")), F.array(_edge("tail", tail))).otherwise(none))


def state_token() -> Column:
    """The effect of a part on the block-comment state; parts without a marker have none."""
    marks = F.transform(F.split("content", r"\r?\n"), lambda line: X.block_marker(line, F.col("family")))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(False).alias("reset"), F.lit(0).alias("odd"))
    effect = F.aggregate(F.filter(marks, lambda m: m.isNotNull()), start, lambda a, m: F.struct(
        m.alias("last"), (a["reset"] | (m == "S")).alias("reset"),
        F.when(m == "S", 0).when(m == "T", 1 - a["odd"]).otherwise(a["odd"]).alias("odd")))
    token = F.transform(F.array(effect), lambda e: F.struct(
        F.lit("state").alias("kind"), e["odd"].alias("pos"), e["last"].alias("marker"), F.when(e["reset"], "S").alias("txt")))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains("content", F.lit(w)) for w in words])
    possible = ((F.col("family") == "c") & has("/*", "*/")) | ((F.col("family") == "py") & has('"""', "'''"))
    return F.when(possible, F.filter(token, lambda t: t["marker"].isNotNull())).otherwise(F.array().cast(D.TOKEN))


def candidates(parts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Candidates of all parts, with ``repo`` as ``struct<repo, part, first_line>``; summaries and array pieces among them."""
    named, derived, _ = D.candidate_columns(tuple(rules), ())
    keyed = parts.withColumn("repo", F.struct(
        "repo", F.col("part").cast("bigint").alias("part"), F.col("first_line").cast("bigint").alias("first_line")))
    tokens = F.concat(D.line_candidates(rules), *D.content_candidates(), state_token(), edge_tokens())
    return keyed.select(*named).select(*derived).select("repo", "path", "name", "ext", "file_context", "safe", F.inline(tokens))


def carried_arrays(cands: DataFrame) -> DataFrame:
    """Character arrays over several parts, as candidates of the part in which they begin.

    A piece goes on where the part before ended; the first closing piece ends the array.  An array with an impossible code
    is dropped, as it is in one piece.
    """
    role = F.array_position(F.array(*[F.lit(e) for e in EDGES]), F.col("kind"))
    in_file = Window.partitionBy("repo.repo", "path").orderBy("repo.part", "role")
    so_far = Window.partitionBy("repo.repo", "path", "nth").orderBy("repo.part", "role")
    whole = Window.partitionBy("repo.repo", "path", "nth")
    ends = F.col("repo.part") + F.col("pos") + 1
    is_tail = F.col("kind") == "tail"
    linked = (F.lag(ends).over(in_file) == F.col("repo.part")) & (F.lag("kind").over(in_file) != "head")
    rows = cands.where(F.col("kind").isin(EDGES)).withColumn("role", role)
    rows = rows.select("*", F.count(F.when(is_tail, 1)).over(in_file).alias("nth"),
                       F.when(is_tail, 0).when(linked, 0).otherwise(1).alias("broken"))
    rows = rows.withColumn("broken", F.sum("broken").over(so_far)).where("nth > 0 AND broken = 0")
    first = F.min_by(F.struct("repo", "name", "ext", "file_context", "safe", "pos", F.char_length("txt").alias("n")), "repo.part")
    pieces = F.sort_array(F.collect_list(F.struct(F.col("repo.part").alias("part"), "txt")))
    arrays = rows.groupBy(F.col("repo.repo").alias("of"), "path", "nth").agg(
        first.alias("f"), F.array_join(F.transform(pieces, lambda p: p["txt"]), "\n").alias("txt"),
        F.bool_or(F.col("kind") == "head").alias("closed"), F.every(F.col("txt").isNotNull()).alias("fine"))
    return arrays.where("closed AND fine").select(
        "f.repo", "path", "f.name", "f.ext", "f.file_context", "f.safe", F.lit("chars").alias("kind"),
        (F.col("f.pos") - F.col("f.n")).cast("int").alias("pos"), F.lit(None).cast("string").alias("marker"), "txt")


def carried_state(cands: DataFrame) -> DataFrame:
    """``(repo, file, carry_mark, carry_odd)``: the comment state at the start of every part that has a candidate."""
    is_state = F.col("kind") == "state"
    parts = cands.groupBy("repo", F.col("path").alias("file")).agg(
        F.max(F.when(is_state, F.col("marker"))).alias("last"), F.coalesce(F.bool_or(is_state & (F.col("txt") == "S")), F.lit(False)).alias("reset"),
        F.coalesce(F.max(F.when(is_state, F.col("pos"))), F.lit(0)).alias("odd"))
    before = Window.partitionBy("repo.repo", "file").orderBy("repo.part").rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.select("*", F.last("last", ignorenulls=True).over(before).alias("carry_mark"),
                          F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("before"))
    at_reset = F.coalesce(F.last(F.when(F.col("reset"), F.col("before")), ignorenulls=True).over(before), F.lit(0))
    return summed.select("repo", "file", "carry_mark", ((F.col("before") - at_reset) % 2).alias("carry_odd"))


def in_block() -> Column:
    toggled = F.col("toggles") - F.coalesce(F.col("at_reset"), -F.col("carry_odd"))
    return F.col("is_line") & F.when(F.col("ext") == "py", F.col("marker").isNotNull() | (toggled % 2 == 1)).otherwise(
        F.coalesce("last_mark", "carry_mark").eqNullSafe("O") | F.col("marker").eqNullSafe("O"))


def hits(parts: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``parts(repo, path, name, part, first_line, content)`` → the rows of ``detect.hits`` for the whole files.

    ``line_no`` counts in the file.  ``pos`` of other candidates is the offset of their part plus their place in it: another
    number than in a file scanned whole, in the same order.  The candidates are written once.
    """
    rules = K.shipped_rules() if rules is None else D.compile_rules(rules)
    cands = stage(candidates(parts, rules))
    special = ["state", *EDGES]
    plain = cands.where(~F.col("kind").isin(special)).unionByName(carried_arrays(cands))
    _, live, nth, out = D.final_columns()
    last_mark, toggles, at_reset, _ = D.state_columns()
    at = F.when(F.col("is_line"), F.col("repo.first_line")).otherwise(F.col("repo.part")) + F.col("pos")
    rows = D.scored_hits(plain, rules).withColumn("pos", at)
    rows = rows.withColumn("line_no", F.when(F.col("is_line"), F.col("pos")).otherwise(-1))
    rows = rows.select("*", last_mark, toggles).select("*", at_reset).join(carried_state(cands), ["repo", "file"])
    rows = rows.withColumn("in_block", in_block()).where("row_kind <> 'mark' AND (NOT comment OR in_block)").select(*live)
    # the first of a kind in its part, then among those the first in the file
    rows = rows.select(*nth).where("NOT once OR nth = 1").drop("nth").withColumn("repo", F.col("repo.repo"))
    return rows.select(*nth).where("NOT once OR nth = 1").select(*out)
