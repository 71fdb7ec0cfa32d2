"""The scan: files in, findings and indicators out.

One pass over the content.  Each file row is turned into a short array of
candidates (gated lines, block-comment markers, encoded tokens, URLs), the
array is exploded, and everything that can be decided row by row is decided
before the only shuffle, which is by file and carries hits and markers but no
file content.  After it, a window restores the block-comment state and the
first hit of each kind per file wins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintscan import catalogue as K
from glintscan.catalogue import Rule
from glintscan.functions import confidence as C, context as X, network as N
from glintscan.sqltext import FLAGS, quote, remembered

# Order of the detectors within a file; also the tie-break of later steps.
STAGES = ["js", "secret", "suspicious", "entropy", "base64", "hex", "urlenc", "chars", "url"]
STAGE = {s: i for i, s in enumerate(STAGES)}

SEQUENCE = ["stage", "line_no", "pos", "rule_no", "match_no"]
FINDING_COLUMNS = [
    "repo", "file", "type", "description", "match_content", "confidence", "file_context", *SEQUENCE,
]

TOKEN = "array<struct<kind:string,pos:int,marker:string,txt:string>>"


def compile_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Check every pattern on the JVM once, so that a bad one fails by name at once."""
    from pyspark.sql import SparkSession

    pattern = SparkSession.getActiveSession().sparkContext._jvm.java.util.regex.Pattern
    for r in rules:
        try:
            pattern.compile(FLAGS + r.pattern)
        except Exception as e:
            raise ValueError(f"invalid pattern in rule {r.id!r}") from e
    return list(rules)


# A pattern with one of these may match a line by itself but not inside the text.
LINE_BOUND = re.compile(r"\\[AZzGbB]|\(\?[=!<>]|[+*?}]\+|\$|(?<!\[)\^")


def line_gate(rules: Sequence[Rule], whole_text: bool = False) -> list[str] | None:
    """Patterns of which every line with a hit matches one.

    Rules without a gate stand for themselves.  For a whole text the result is
    None when such a rule looks at the borders of the line.
    """
    gated_rules = [r for r in rules if r.gate is not None]
    plain = [r for r in rules if r.gate is None]
    if whole_text and any(LINE_BOUND.search(r.pattern.replace(r"\b", "")) for r in plain):
        return None
    return K.gate_patterns([alt for r in gated_rules for alt in r.gate]) + [FLAGS + r.pattern for r in plain]


def matches_any(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, [matches(text, p) for p in patterns], F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def _none(dtype: str) -> Column:
    return F.array().cast(dtype)


def tokens(kind: str, texts: Column) -> Column:
    return F.transform(
        texts,
        lambda t, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), F.lit(None).cast("string").alias("marker"), t.alias("txt")
        ),
    )


def gated(condition: Column, texts: Column, kind: str) -> Column:
    return F.when(condition, tokens(kind, texts)).otherwise(_none(TOKEN))


def line_candidates(rules: Sequence[Rule]) -> Column:
    """Gated lines with their numbers, plus block-comment markers of such files."""
    is_js = F.col("ext").isin(K.JS_EXTENSIONS)

    def wanted(text: Column, gate: list[str] | None) -> Column:
        by_rule = matches_any(text, gate) if gate is not None else F.lit(True)
        by_word = reduce(or_, [F.contains(text, F.lit(w)) for w in K.JS_KEYWORDS])
        return by_rule | (is_js & by_word)

    lines = F.transform(
        F.split("content", r"\r?\n"),
        lambda line, i: F.struct(
            F.lit("line").alias("kind"), i.alias("pos"),
            X.block_marker(line, F.col("family")).alias("marker"),
            F.when(wanted(line, line_gate(rules)), line).alias("txt"),
        ),
    )
    kept = F.filter(lines, lambda t: t["txt"].isNotNull() | t["marker"].isNotNull())
    return F.when(wanted(F.col("content"), line_gate(rules, whole_text=True)), kept).otherwise(_none(TOKEN))


def content_candidates() -> list[Column]:
    c = F.col("content")
    has_base64_url = F.contains(c, F.lit("aHR0c")) | F.contains(c, F.lit("odHRw")) | F.contains(c, F.lit("h0dH"))
    digits_array = rf"\[([0-9,{K.BLANK}]{{8,}}+)\]"
    return [
        gated(
            F.col("ext").isin(K.ENTROPY_EXTENSIONS),
            F.regexp_extract_all(c, F.lit(K.LONG_STRING), F.lit(1)), "entropy",
        ),
        # "http" in base64, at each of the three alignments
        gated(has_base64_url, F.filter(
            F.regexp_extract_all(c, F.lit(FLAGS + K.BASE64_TOKEN), F.lit(1)),
            lambda t: matches(t, "aHR0c|odHRw|h0dH"),
        ), "base64"),
        gated(
            matches(c, r"""["'\\](?:[0-9a-fA-F]{16}|[xX][0-9a-fA-F]{2}\\)"""),
            F.regexp_extract_all(c, F.lit(K.HEX_TOKEN), F.lit(0)), "hex",
        ),
        gated(
            F.contains(c, F.lit("%3")) & matches(c, "%3[aA]%2[fF]%2[fF]"),
            F.regexp_extract_all(c, F.lit(FLAGS + K.URL_ENCODED_DSN), F.lit(0)), "urlenc",
        ),
        gated(
            F.contains(c, F.lit("[")) & matches(c, digits_array),
            F.filter(F.regexp_extract_all(c, F.lit(digits_array), F.lit(1)),
                     lambda t: matches(t, r"[0-9](?:[^0-9]+[0-9]{2,3}){7}")), "chars",
        ),
        gated(
            F.contains(c, F.lit("http")),
            F.array_distinct(F.regexp_extract_all(c, F.lit(FLAGS + K.URL), F.lit(0))), "url",
        ),
    ]


@remembered
def candidate_columns(rules: tuple[Rule, ...], kept_names: tuple[str, ...]) -> tuple[list[Column], ...]:
    whole = gated(F.col("name").isin(*kept_names), F.array("content"), "whole") if kept_names else _none(TOKEN)
    return (
        ["repo", "path", "name", "content", X.extension(F.col("name")).alias("ext")],
        ["*", X.comment_family(F.col("ext")).alias("family"), X.file_context(F.col("path")).alias("file_context"),
         X.is_safe_context(F.col("path"), F.col("ext")).alias("safe")],
        ["repo", "path", "name", "ext", "file_context", "safe", F.inline(F.concat(line_candidates(rules), *content_candidates(), whole))],
    )


def candidates(files: DataFrame, rules: Sequence[Rule], kept_names: Sequence[str] = ()) -> DataFrame:
    """``files(repo, path, name, content)`` → one row per candidate, content dropped.

    Files of ``kept_names`` leave their content as one more candidate of the kind ``whole``, so that a caller who needs it
    too does not read all content again.
    """
    return reduce(lambda df, columns: df.select(*columns), candidate_columns(tuple(rules), tuple(kept_names)), files)


# ---------------------------------------------------------------------------
# Candidates to hits (row-local).  The array of possible hits is SQL text: it
# repeats one CASE per rule, and every pattern stays a literal in the plan.
# ---------------------------------------------------------------------------
def _case(condition: str, row_kind: str, stage: str, rule_no: int, ftype: str | None, description: str | None,
          base: float | None, once: bool, before: str, found: str) -> str:
    text = lambda v: "CAST(NULL AS STRING)" if v is None else quote(v)
    conf = "CAST(NULL AS DOUBLE)" if base is None else f"{base}D"
    return (
        f"CASE WHEN {condition} THEN named_struct('row_kind', {quote(row_kind)}, 'stage', {STAGE.get(stage, -1)}, "
        f"'rule_no', {rule_no}, 'type', {text(ftype)}, 'description', {text(description)}, 'base', {conf}, "
        f"'once', {str(once).lower()}, 'before', {before}, 'found', {found}) END"
    )


NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"


def _rlike(text: str, pattern: str) -> str:
    return f"rlike({text}, {quote(pattern)})"


def gate_test(gate: list[tuple[str, str]], text: str) -> str:
    """The gate of one rule: a byte search for each rare character, then its alternative."""
    out = []
    for first, rest in gate:
        for ch in first:
            here = f"contains({text}, {quote(ch)})"
            if re.fullmatch(r"[A-Za-z0-9_ /{:=\"-]*|\\\{[a-z:]*", rest):
                out.append(f"contains({text}, {quote(ch + rest.replace(chr(92), ''))})")
            else:
                out.append(f"({here} AND {_rlike(text, re.escape(ch) + '(?:' + rest + ')')})")
    return "(" + " OR ".join(out) + ")"


def variants(rule: Rule, text: str) -> list[tuple[str, str]]:
    """``(condition, pattern)`` pairs of which at most one holds: how to match the rule on a text."""
    pattern = rule.linear or rule.pattern
    gate = f"{gate_test(rule.gate, text)} AND " if rule.gate else ""
    body = lambda p: _rlike(text, f"{FLAGS}{K.LEADS.get(rule.id, '')}(?:{p})")
    if rule.linear and rule.id in K.GUARDS:
        guard, rest = K.GUARDS[rule.id]
        possible = _rlike(text, FLAGS + guard)
        return [(f"{gate}{possible} AND {body(pattern)}", pattern), (f"{gate}NOT {possible} AND {body(rest)}", rest)]
    return [(gate + body(pattern), pattern)]


def with_prefix(rule: Rule, pattern: str) -> str:
    """Group 1 is the text since the previous match, group 2 the match.

    Every match starts where the last one ended, so that the rest of a long
    line is searched once and not again from each of its characters.
    """
    return f"{FLAGS}\\G((?s:.*?){K.LEADS.get(rule.id, '')})({pattern})"


def line_hits(rules: Sequence[Rule]) -> list[str]:
    """Possible hits of one line: its marker, script keywords, every rule."""
    out = [_case("marker IS NOT NULL", "mark", "", 0, None, None, None, False, NO_TEXTS, "array('')")]
    for no, word in enumerate(K.JS_KEYWORDS):
        out.append(_case(
            f"is_js AND contains(txt, {quote(word)})", "finding", "js", no, "Suspicious JS Keyword",
            f"Suspicious JS keyword '{word}'", K.BASE_CONFIDENCE["Suspicious JS Keyword"], True, NO_TEXTS, "array(trimmed)",
        ))
    for no, rule in enumerate(rules):
        base = K.BASE_CONFIDENCE.get(rule.id, K.DEFAULT_CONFIDENCE)
        for condition, pattern in variants(rule, "txt"):
            wrapped = quote(with_prefix(rule, pattern))
            texts = [f"regexp_extract_all(txt, {wrapped}, {g})" for g in (1, 2)]
            if rule.klass == K.SUSPICIOUS:
                out.append(_case(f"talks AND {condition}", "finding", "suspicious", no, rule.id,
                                 f"Comando suspeito: '{rule.id}'", base, False, *texts))
            elif rule.id == "Generic API Key":
                out.append(_case(condition, "finding", "secret", no, rule.id, "Possible API key.", base, False, *texts))
            else:
                out.append(_case(condition, "finding", "secret", no, rule.id,
                                 f"Possible exposed secret '{rule.id}'", base, True, *texts))
    return out


def token_hits(rules: Sequence[Rule]) -> list[str]:
    """Possible hits of an encoded token, a long string or a URL."""
    urls = f"regexp_extract_all(decoded, {quote(FLAGS + K.URL)}, 0)"
    out = [
        _case("kind = 'entropy'", "finding", "entropy", 0, "High Entropy String", None, None, True, NO_TEXTS, "array(txt)"),
        _case("kind = 'url'", "ioc", "url", 0, None, None, None, True, NO_TEXTS, "array(txt)"),
        _case("kind = 'base64'", "both", "base64", 0, "Hidden IOC (Base64)", "Obfuscated URL in Base64: ", 0.70, True, NO_TEXTS, urls),
        _case("kind = 'hex'", "both", "hex", 0, "Hidden IOC (Hex)", "Obfuscated URL in hex: ", 0.75, False, NO_TEXTS, urls),
        _case("kind = 'chars'", "both", "chars", 0, "Hidden IOC (Char Array)", "Obfuscated URL in char array: ", 0.80, False, NO_TEXTS, urls),
        _case("kind = 'urlenc'", "finding", "urlenc", 0, "Hidden IOC (URL Encoded)", "URL-encoded connection string: ", 0.85, False, NO_TEXTS, "array(decoded)"),
        _case("kind = 'urlenc'", "ioc", "urlenc", 1, None, None, None, False, NO_TEXTS, urls),
    ]
    for stage, ftype, label, conf in [
        ("hex", "Hidden IOC (Hex)", "hex encoding", 0.80), ("chars", "Hidden IOC (Char Array)", "char array", 0.85),
    ]:
        out += [
            _case(f"kind = '{stage}' AND {variants(r, 'decoded')[0][0]}", "finding", stage, no + 1, ftype,
                  f"Secret '{r.id}' hidden in {label}", conf, False, NO_TEXTS, "array(decoded)")
            for no, r in enumerate(rules) if r.klass == K.SECRET
        ]
    return out


def possible_hits(rules: Sequence[Rule]) -> Column:
    lines, others = ", ".join(line_hits(rules)), ", ".join(token_hits(rules))
    return F.expr(
        f"filter(CASE WHEN kind = 'line' THEN array({lines}) "
        f"WHEN kind IN ('entropy', 'url') OR decoded IS NOT NULL THEN array({others}) END, h -> h IS NOT NULL)"
    )


def decoded_base64(token: Column) -> Column:
    """Strict decode: padded or unpadded alphabet, no stray trailing bits, valid UTF-8."""
    raw = F.try_to_binary(token, F.lit("base64"))
    again = F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))
    strict = (token == again) | (token == F.rtrim(again, F.lit("=")))
    return F.when(matches(token, r"^[A-Za-z0-9+/]+={0,2}\z") & strict, F.try_validate_utf8(raw.cast("string")))


def decoded_hex(token: Column) -> Column:
    digits = F.regexp_replace(token, r"""(?i)^(?:0x)?["']|["']\z|\\x""", "")
    even = F.char_length(digits) % 2 == 0
    return F.when(even, F.try_validate_utf8(F.try_to_binary(digits, F.lit("hex")).cast("string")))


def decoded_percent(token: Column) -> Column:
    """Percent-decode ASCII bytes only; everything else stays as written."""
    plain = F.regexp_replace(F.replace(token, F.lit("+"), F.lit("%2B")), "%(?![0-7][0-9A-Fa-f])", "%25")
    return F.try_url_decode(plain)


def decoded_chars(token: Column) -> Column:
    """Comma separated character codes, all of them printable ASCII."""
    parts = F.transform(F.split(token, ","), X.blank_trim)
    codes = F.transform(parts, lambda p: F.when(matches(p, r"^[0-9]{2,3}\z"), p.try_cast("int")))
    fine = (F.size(codes) >= 8) & F.coalesce(F.forall(codes, lambda v: v.between(32, 126)), F.lit(False))
    return F.when(fine, F.array_join(F.transform(codes, F.chr), ""))


SINGLE = ["repo", "path", "ext", "file_context", "pos", "marker", "comment", "is_line", "row_kind", "stage", "rule_no", "type",
          "description", "base", "once"]


@remembered
def hit_columns(rules: tuple[Rule, ...]) -> list[list[Column]]:
    """The steps from candidates to hits, each a list of columns over the one before."""
    kind, txt = F.col("kind"), F.col("txt")
    decoded = (
        F.when(kind == "base64", decoded_base64(txt))
        .when(kind == "hex", decoded_hex(txt))
        .when(kind == "urlenc", decoded_percent(txt))
        .when(kind == "chars", decoded_chars(txt))
    )
    prepared = [
        "*", decoded.alias("decoded"), X.blank_trim(txt).alias("trimmed"),
        F.col("ext").isin(K.JS_EXTENSIONS).alias("is_js"),
        (~F.col("safe") & ~X.is_import_or_log(txt)).alias("talks"),
        ((kind == "line") & X.is_comment(txt, F.col("ext"))).alias("comment"),
    ]
    by_rule = ["repo", "path", "ext", "file_context", "pos", "marker", "comment",
               (kind == "line").alias("is_line"), F.inline(possible_hits(rules))]
    single = [*SINGLE, "before", F.posexplode("found").alias("match_no", "match_content"), F.col("found").alias("found")]
    # the text before a match: since the previous match, or that match when nothing but blanks lies between
    n = F.col("match_no")
    tail = F.coalesce(
        C.assignment_tail(F.try_element_at("before", n + 1)),
        F.when(n > 0, C.assignment_tail(F.try_element_at("found", n))),
        F.lit(False),
    )
    stage, match, base = F.col("stage"), F.col("match_content"), F.col("base")
    at = lambda *names: stage.isin([STAGE[x] for x in names])
    is_url = F.col("row_kind").isin("both", "ioc")
    host = F.when(is_url, N.url_host(match))
    measured = [
        *SINGLE, "match_no", "match_content", tail.alias("assigned"),
        F.when(at("secret", "suspicious", "entropy"), C.entropy(match)).alias("bits"),
        host.alias("host"), F.when(N.is_numeric_host(host), N.ipv4_value(host)).alias("address"),
    ]
    confidence = (
        F.when(at("secret", "suspicious"), C.pattern_confidence(base, match, F.col("bits"), F.col("assigned")))
        .when(at("entropy"), C.entropy_confidence(F.col("bits")))
        .otherwise(base)
    )
    description = (
        F.when(at("entropy"), F.format_string("High entropy string (%.2f)", F.col("bits")))
        .when(F.col("row_kind") == "both", F.concat("description", F.left(match, F.lit(50)), F.lit("...")))
        .when(at("urlenc"), F.concat("description", F.left(match, F.lit(60)), F.lit("...")))
        .otherwise(F.col("description"))
    )
    row_kinds = (
        F.when(at("entropy") & (F.col("bits") <= K.ENTROPY_LIMIT), F.array().cast("array<string>"))
        .when(is_url & ~N.is_public_host(F.col("host"), F.col("address")), F.array().cast("array<string>"))
        .when(F.col("row_kind") == "both", F.array(F.lit("finding"), F.lit("ioc")))
        .otherwise(F.array("row_kind"))
    )
    scored = [
        "repo", F.col("path").alias("file"), "ext", "file_context", "is_line", "pos", "marker", "comment",
        "stage", "rule_no", "match_no", "type", description.alias("description"), "match_content",
        confidence.alias("confidence"), "once", F.explode(row_kinds).alias("row_kind"),
    ]
    return [prepared, by_rule, single, measured, scored]


def scored_hits(cands: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Candidates to single hits with a confidence before file context; still no shuffle."""
    return reduce(lambda df, columns: df.select(*columns), hit_columns(tuple(rules)), cands)


@remembered
def state_columns() -> tuple[Column, ...]:
    """Last marker, toggles and toggles at the last reset on the lines before, and the state that follows from them."""
    earlier_lines = Window.partitionBy("repo", "file").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("row_kind") == "mark", F.col("marker"))
    toggles = F.coalesce(F.sum(F.when(mark == "T", 1).otherwise(0)).over(earlier_lines), F.lit(0))
    in_block = F.col("is_line") & F.when(
        F.col("ext") == "py",
        F.col("marker").isNotNull() | ((F.col("toggles") - F.coalesce("at_reset", F.lit(0))) % 2 == 1),
    ).otherwise(F.col("last_mark").eqNullSafe("O") | F.col("marker").eqNullSafe("O"))
    return (F.last(mark, ignorenulls=True).over(earlier_lines).alias("last_mark"), toggles.alias("toggles"),
            F.last(F.when(mark == "S", F.col("toggles")), ignorenulls=True).over(earlier_lines).alias("at_reset"), in_block.alias("in_block"))


def block_state(rows: DataFrame) -> DataFrame:
    """Adds ``in_block`` to line hits from the marker rows before them in the file.

    C family: the last earlier marker was an opening, or this line opens.
    Python: an odd number of toggles since the last one-line docstring.
    """
    last_mark, toggles, at_reset, in_block = state_columns()
    return rows.select("*", last_mark, toggles).select("*", at_reset).select(*[F.col(c) for c in rows.columns], in_block)


@remembered
def final_columns() -> list[list[Column]]:
    damp = F.when(F.col("in_block"), 0.1).otherwise(1.0)
    by_match = (F.col("row_kind") == "ioc") | (F.col("stage") == STAGE["base64"])
    kind_key = F.when(by_match, F.col("match_content")).otherwise(F.concat_ws("\u0001", "type", "description"))
    order = [F.col(c) for c in ("stage", "line_no", "pos", "rule_no", "match_no")]
    first = Window.partitionBy("repo", "file", "row_kind", "once", "kind_key").orderBy(*order)
    is_finding = F.col("row_kind") == "finding"
    return [
        ["*", F.when(F.col("is_line"), F.col("pos")).otherwise(-1).alias("line_no")],
        ["row_kind", "repo", "file", "type", "description", "match_content", "file_context", "stage", "line_no",
         "pos", "rule_no", "match_no", "once", kind_key.alias("kind_key"),
         C.clamp(F.col("confidence") * X.context_multiplier(F.col("file_context")) * damp).alias("confidence")],
        ["*", F.row_number().over(first).alias("nth")],
        ["row_kind", "repo", "file", *[F.when(is_finding, F.col(c)).alias(c) for c in ("type", "description")], "match_content",
         F.when(is_finding, F.col("confidence")).alias("confidence"), "file_context", *SEQUENCE],
    ]


def hits(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Findings and indicators of all files in one DataFrame (``row_kind``)."""
    rules = K.shipped_rules() if rules is None else compile_rules(rules)
    return hits_of(candidates(files, rules), rules)


def hits_of(cands: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Candidates to findings and indicators.

    The hits are spread by file before the window; ``once`` rows (most kinds)
    keep only the first hit of their kind in the file.
    """
    line_no, live, nth, out = final_columns()
    rows = block_state(scored_hits(cands.where("kind <> 'whole'"), rules).select(*line_no))
    rows = rows.where("row_kind <> 'mark' AND (NOT comment OR in_block)").select(*live).select(*nth)
    return rows.where("NOT once OR nth = 1").select(*out)


def findings_of(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.where("row_kind = 'finding'").select(*FINDING_COLUMNS)


def iocs_of(hit_rows: DataFrame) -> DataFrame:
    return hit_rows.where("row_kind = 'ioc'").select(
        "repo", F.col("match_content").alias("ioc"), F.col("file").alias("source_file"), *SEQUENCE
    )
