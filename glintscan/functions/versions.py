"""Version numbers as texts that sort in the order of their ecosystem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SEMVER = ["npm", "crates.io", "Go"]
# What may follow the numbers of a release; letters of the key tell what comes before what.
DEV, PRE, FINAL, POST, NUMBER = "a", "b", "c", "d", "e"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _number(digits: Column) -> Column:
    """Digits with their count in front, so that numbers of any length compare as texts."""
    return let(F.ltrim(digits, F.lit("0")), lambda n: F.concat(F.lpad(F.char_length(n).cast("string"), 4, "0"), n))


def _identifier(part: Column) -> Column:
    """Numbers before words, and the end of the list (``0``) before both."""
    return F.when(F.rlike(part, F.lit(r"^[0-9]+\z")), F.concat(F.lit("1"), _number(part))).otherwise(F.concat(F.lit("2"), part, F.lit(" ")))


def _listed(parts: Column) -> Column:
    return F.concat(F.array_join(F.transform(parts, _identifier), ""), F.lit("0"))


def _counted(text: Column, word: str) -> Column:
    """The number after ``word``; a missing one counts as 0, a missing word gives NULL."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|[-_.0-9])(?:{word})(?![a-z])[-_.]?([0-9]*)"), F.lit(1))
    return F.try_element_at(F.transform(found, _number), F.lit(1))


def _semver_rest(rest: Column) -> Column:
    return F.when(rest == "", FINAL).otherwise(F.concat(F.lit(PRE), _listed(F.split(F.regexp_replace(rest, "^[-.]", ""), r"\."))))


def _python_rest(rest: Column) -> Column:
    phases = [("a", "alpha|a"), ("b", "beta|b"), ("c", "rc|c|preview|pre")]

    def found(text: Column) -> Column:
        short = F.when(F.rlike(text, F.lit(r"^-[0-9]+")), _number(F.regexp_extract(text, "^-([0-9]+)", 1)))
        return F.struct(
            _counted(text, "dev").alias("dev"), F.coalesce(_counted(text, "post|rev|r"), short).alias("post"),
            F.coalesce(*[F.concat(F.lit(p), _counted(text, w)) for p, w in phases]).alias("phase"), text.alias("text"))

    def key(f: Column) -> Column:
        late = F.concat(F.coalesce(F.concat(F.lit("2"), f["post"]), F.lit("1")), F.coalesce(F.concat(F.lit("1"), f["dev"]), F.lit("2")))
        return (F.when(f["phase"].isNotNull(), F.concat(F.lit(PRE), f["phase"], late)).when(f["post"].isNotNull(), F.concat(F.lit(POST), late))
                .when(f["dev"].isNotNull(), F.concat(F.lit(DEV), f["dev"])).when(f["text"] == "", FINAL))

    return let(let(F.lower(rest), found), key)


def _other_rest(rest: Column) -> Column:
    def key(words: Column) -> Column:
        first = F.try_element_at(words, F.lit(1))
        kind = F.when(F.rlike(first, F.lit(r"^(?:p|pl|patch)\z")), POST).when(first == "dev", DEV).otherwise(PRE)
        return F.when(F.size(words) > 0, F.concat(kind, _listed(words)))

    return F.when(rest == "", FINAL).otherwise(let(F.regexp_extract_all(F.lower(rest), F.lit("([0-9]+|[a-z]+)"), F.lit(1)), key))


def version_key(ecosystem: Column, version: Column) -> Column:
    """A text that sorts like the version; NULL for what is no version.

    npm, crates.io and Go: numbers, then dotted pre-release words.  PyPI: epoch, then dev, a, b, rc, final, post.  Others:
    ``dev`` first, other words before the release, ``p`` and ``patch`` after it.  Trailing zeros, a leading ``v`` and
    build or local parts after ``+`` do not count.
    """
    text = F.regexp_replace(F.btrim(version), r"(?s)^[vV=]+|\+.*\z", "")

    def parts(t: Column) -> Column:
        body = F.when(ecosystem == "PyPI", F.regexp_replace(t, "^[0-9]+!", "")).otherwise(t)
        return F.struct(F.regexp_extract(t, "^([0-9]+)!", 1).alias("epoch"), body.alias("body"),
                        F.regexp_extract(body, r"^([0-9]+(?:\.[0-9]+)*+)", 1).alias("release"))

    def key(p: Column) -> Column:
        numbers = F.split(F.regexp_replace(p["release"], r"(?:\.0+)+\z", ""), r"\.")
        tail = let(F.substr(p["body"], F.char_length(p["release"]) + 1), lambda rest: F.when(ecosystem.isin(SEMVER), _semver_rest(rest)).when(
            ecosystem == "PyPI", _python_rest(rest)).otherwise(_other_rest(rest)))
        era = _number(F.when(ecosystem == "PyPI", p["epoch"]).otherwise(""))
        return F.when(p["release"] != "", F.concat(
            era, F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(NUMBER), _number(n))), ""), tail))

    return let(let(text, parts), key)
