"""SQL building blocks for the twins of the registered queries.

Written from the rule texts alone: every pattern runs on every line, without
the gates, rewritten patterns and candidate rows that the Spark plans use.
"""

from __future__ import annotations

from glintscan import catalogue as K
from workload.corpus import DUCK, files_sql, sql_text as q

BLANK = "[" + K.BLANK + "]"


def any_contains(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def any_suffix(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {q(w)})" for w in words) + ")"


def any_prefix(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def in_list(x: str, words: list[str]) -> str:
    return f"{x} IN (" + ", ".join(q(w) for w in words) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{BLANK}+|{BLANK}+$')}, '', 'g')"


def case_of(x: str, table: dict, default) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


EXT = "lower(regexp_extract({0}, '[^.]*$'))"
NAME = "regexp_extract({0}, '[^/]*$')"


def context(path: str) -> str:
    p = f"('/' || lower({path}))"
    n = NAME.format(p)
    return f"""CASE
      WHEN {any_contains(p, K.TEST_DIRS)} OR {any_prefix(n, K.TEST_PREFIXES)} OR {any_suffix(n, K.TEST_SUFFIXES)} THEN 'Test'
      WHEN {any_contains(p, K.EXAMPLE_DIRS)} THEN 'Example'
      WHEN {any_contains(n, K.TEMPLATE_PARTS)} THEN 'Template'
      WHEN {any_contains(p, K.DOC_DIRS)} OR {any_suffix(n, K.DOC_SUFFIXES)} OR {n} = 'readme' THEN 'Documentation'
      ELSE 'Production' END"""


def safe(path: str, ext: str) -> str:
    return f"({in_list(ext, K.SAFE_EXTENSIONS)} OR {any_contains(f'lower({path})', K.SAFE_PATH_PARTS)})"


def comment(t: str, ext: str) -> str:
    return f"""CASE WHEN {t} = '' THEN true
      WHEN {in_list(ext, K.HASH_COMMENT_EXTENSIONS)} THEN starts_with({t}, '#')
      WHEN {in_list(ext, K.SLASH_COMMENT_EXTENSIONS)} THEN {any_prefix(t, ['//', '*', '/*'])}
      WHEN {ext} = 'sql' THEN starts_with({t}, '--') ELSE false END"""


def entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, c, ''))) / CAST(strlen({s}) AS DOUBLE))"
    return (f"(CASE WHEN {s} = '' THEN CAST(0 AS DOUBLE) ELSE coalesce(-list_sum(list_transform(list_distinct("
            f"list_filter(string_split({s}, ''), lambda c: c <> '')), lambda c: {p} * log2({p}))), CAST(0 AS DOUBLE)) END)")


def placeholder(s: str) -> str:
    return any_contains(f"lower({s})", K.PLACEHOLDERS)


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^https?://([a-zA-Z0-9._-]+)', 1))"


def public(url: str) -> str:
    """Dotted quads and names; the short numeric forms do not occur in the inputs."""
    h = host(url)
    o = lambda i: f"CAST(split_part({h}, '.', {i}) AS INT)"
    return f"""(CASE WHEN {h} = '' THEN false
      WHEN regexp_matches({h}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN
        CASE WHEN greatest({o(1)}, {o(2)}, {o(3)}, {o(4)}) > 255 THEN false
        ELSE NOT ({o(1)} IN (10, 127) OR ({o(1)} = 172 AND {o(2)} BETWEEN 16 AND 31) OR ({o(1)} = 192 AND {o(2)} = 168)
          OR ({o(1)} = 169 AND {o(2)} = 254) OR {h} = '255.255.255.255' OR ({o(1)} = 192 AND {o(2)} = 0 AND {o(3)} = 2)
          OR ({o(1)} = 198 AND {o(2)} = 51 AND {o(3)} = 100) OR ({o(1)} = 203 AND {o(2)} = 0 AND {o(3)} = 113)) END
      WHEN regexp_matches({h}, '(^|[.])[0-9]+$') THEN false
      ELSE NOT ({in_list(h, K.QUIET_HOSTS)} OR {any_suffix(h, K.QUIET_SUFFIXES)}) END)"""


# --- common table expressions ----------------------------------------------
def files_ctes() -> list[str]:
    return [
        f"files AS MATERIALIZED ({files_sql(DUCK)})",
        f"""f AS MATERIALIZED (SELECT repo, path, name, content, doc_id, {EXT.format('name')} AS ext,
              {context('path')} AS file_context FROM files)""",
        f"fm AS MATERIALIZED (SELECT *, {case_of('file_context', K.CONTEXT_MULTIPLIER, 1.0)} AS mult, {safe('path', 'ext')} AS safe FROM f)",
    ]


def line_ctes() -> list[str]:
    split = r"string_split_regex(content, '\r?\n')"
    py_open = f"{any_prefix('t', ['\"\"\"'])}"
    return [
        f"""l0 AS (SELECT repo, path, ext, file_context, mult, safe, unnest({split}) AS line,
              generate_subscripts({split}, 1) - 1 AS line_no FROM fm)""",
        f"l1 AS (SELECT *, {trim('line')} AS t FROM l0)",
        f"""l2 AS (SELECT *, CASE
              WHEN {in_list('ext', K.BLOCK_COMMENT_EXTENSIONS)} THEN
                CASE WHEN contains(line, '*/') THEN 'C' WHEN contains(line, '/*') THEN 'O' END
              WHEN ext = 'py' AND {py_open} THEN CASE WHEN contains(substr(t, 4), '\"\"\"') THEN 'S' ELSE 'T' END
              WHEN ext = 'py' AND starts_with(t, '''''''') THEN CASE WHEN contains(substr(t, 4), '''''''') THEN 'S' ELSE 'T' END
              END AS marker FROM l1)""",
        """l3 AS (SELECT *,
              last_value(marker IGNORE NULLS) OVER w AS last_marker,
              coalesce(sum(CASE WHEN marker = 'S' THEN 1 ELSE 0 END) OVER w, 0) AS seg FROM l2
              WINDOW w AS (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        """l4 AS (SELECT *, coalesce(sum(CASE WHEN marker = 'T' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path, seg ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS toggles FROM l3)""",
        f"""lines AS MATERIALIZED (SELECT repo, path, ext, file_context, mult, safe, line, line_no, t,
              {comment('t', 'ext')} AS is_comment,
              CASE WHEN ext = 'py' THEN marker IS NOT NULL OR toggles % 2 = 1
                   ELSE coalesce(last_marker = 'O', false) OR coalesce(marker = 'O', false) END AS in_block FROM l4)""",
        """live AS MATERIALIZED (SELECT *, CASE WHEN in_block THEN CAST(0.1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS damp
              FROM lines WHERE NOT is_comment OR in_block)""",
    ]


STAGES = ["js", "secret", "suspicious", "entropy", "base64", "hex", "urlenc", "chars", "url"]


def rule_cte(name: str, rules: dict[str, str], kind: str) -> list[str]:
    """All matches of all rules of one class, with the text before each match."""
    parts = []
    order = list(rules)
    for no, rid in enumerate(order):
        if K.rule_kind(rid) != kind:
            continue
        pattern = rules[rid]
        wrapped = q(f"((?s:.*?))({pattern})")
        extra = "" if kind == K.SECRET else (
            f" AND NOT safe AND NOT (starts_with(t, 'import ') OR starts_with(t, 'from ') OR contains(t, 'console.log'))")
        parts.append(
            f"SELECT repo, path, file_context, mult, damp, line_no, {no} AS rule_no, {q(rid)} AS type, "
            f"regexp_extract_all(line, {wrapped}, 1) AS p, regexp_extract_all(line, {wrapped}, 2) AS m "
            f"FROM live WHERE regexp_matches(line, {q(pattern)}){extra}")
    base = case_of("type", K.BASE_CONFIDENCE, K.DEFAULT_CONFIDENCE)
    return [
        f"{name}_raw AS ({' UNION ALL '.join(parts)})",
        f"""{name}_each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_raw)""",
        f"""{name}_one AS MATERIALIZED (SELECT repo, path, file_context, mult, damp, line_no, rule_no, type, i - 1 AS match_no, m[i] AS match_content,
              array_to_string(list_transform(range(1, i), lambda j: p[j] || m[j]), '') || p[i] AS before FROM {name}_each)""",
        f"{name}_bits AS (SELECT *, {entropy('match_content')} AS bits FROM {name}_one)",
        f"""{name}_scored AS (SELECT *, CASE WHEN {placeholder('match_content')} THEN CAST(0.05 AS DOUBLE)
              ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {base}
                + CASE WHEN strlen(match_content) >= 16 THEN CASE WHEN bits > 5.5 THEN CAST(0.1 AS DOUBLE) WHEN bits < 3.5 THEN CAST(-0.2 AS DOUBLE)
                    ELSE CAST(0 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END
                + CASE WHEN regexp_matches(before, {q(f'(=|:|=>){BLANK}*$')}) THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END))
              END AS raw FROM {name}_bits)""",
    ]


def clamp(x: str) -> str:
    return f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), {x}))"


def js_cte() -> list[str]:
    parts = [
        f"SELECT repo, path, file_context, mult, damp, line_no, {no} AS rule_no, {q(w)} AS word, t FROM live "
        f"WHERE ext IN ('js', 'ts') AND contains(line, {q(w)})" for no, w in enumerate(K.JS_KEYWORDS)]
    return [f"js_raw AS ({' UNION ALL '.join(parts)})"]


def secret_test(decoded: str, rules: dict[str, str], stage: str, label: str, ftype: str, conf: float, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'finding' AS row_kind, repo, path AS file, {q(ftype)} AS type, {q(f'Secret {chr(39)}{rid}{chr(39)} hidden in {label}')} AS description, "
        f"{decoded} AS match_content, {clamp(f'CAST({conf} AS DOUBLE) * mult')} AS confidence, file_context, {STAGES.index(stage)} AS stage, "
        f"-1 AS line_no, pos, {no + 1} AS rule_no, 0 AS match_no, false AS once FROM {source} "
        f"WHERE regexp_matches({decoded}, {q(pattern)})"
        for no, (rid, pattern) in enumerate(rules.items()) if K.rule_kind(rid) == K.SECRET)


def token_ctes(rules: dict[str, str]) -> list[str]:
    tok = lambda pattern, group: (
        f"unnest(regexp_extract_all(content, {q(pattern)}, {group})) AS tok, "
        f"generate_subscripts(regexp_extract_all(content, {q(pattern)}, {group}), 1) - 1 AS pos")
    b64_body = "tok || CASE length(tok) % 4 WHEN 2 THEN '==' WHEN 3 THEN '=' ELSE '' END"
    b64_fine = "regexp_matches(tok, '^[A-Za-z0-9+/]+={0,2}$') AND (length(tok) % 4 = 0 OR (NOT contains(tok, '=') AND length(tok) % 4 IN (2, 3)))"
    hex_digits = r"""regexp_replace(tok, '(?i)^(?:0x)?["'']|["'']$|\\x', '', 'g')"""
    percent = "url_decode(replace(replace(replace(regexp_replace(tok, '%([0-7][0-9A-Fa-f])', chr(1) || '\\1', 'g'), '%', '%25'), chr(1), '%'), '+', '%2B'))"
    digits = f"""\\[([0-9,{K.BLANK}]+)\\]"""
    codes = f"list_transform(string_split(tok, ','), lambda x: {trim('x')})"
    return [
        f"""entropy_tok AS (SELECT repo, path, file_context, mult, tok, pos, {entropy('tok')} AS bits FROM
              (SELECT repo, path, file_context, mult, {tok(K.LONG_STRING, 1)} FROM fm WHERE {in_list('ext', K.ENTROPY_EXTENSIONS)}))""",
        f"b64_tok AS (SELECT repo, path, file_context, mult, {tok(K.BASE64_TOKEN, 1)} FROM fm)",
        f"""b64_bin AS (SELECT *, TRY(from_base64(padded)) AS bin FROM (SELECT *, {b64_body} AS padded FROM b64_tok WHERE {b64_fine}))""",
        "b64 AS MATERIALIZED (SELECT *, TRY(decode(bin)) AS decoded FROM b64_bin WHERE to_base64(bin) = padded)",
        f"hex_tok AS (SELECT *, {hex_digits} AS digits FROM (SELECT repo, path, file_context, mult, {tok(K.HEX_TOKEN, 0)} FROM fm))",
        "hexed AS MATERIALIZED (SELECT *, TRY(decode(TRY(unhex(digits)))) AS decoded FROM hex_tok WHERE length(digits) % 2 = 0)",
        f"dsn AS MATERIALIZED (SELECT *, {percent} AS decoded FROM (SELECT repo, path, file_context, mult, {tok(K.URL_ENCODED_DSN, 0)} FROM fm))",
        f"chr_tok AS (SELECT *, {codes} AS codes FROM (SELECT repo, path, file_context, mult, {tok(digits, 1)} FROM fm))",
        """chars AS MATERIALIZED (SELECT *, array_to_string(list_transform(codes, lambda x: chr(CAST(x AS INT))), '') AS decoded FROM chr_tok
              WHERE len(codes) >= 8 AND list_bool_and(list_transform(codes, lambda x: regexp_matches(x, '^[0-9]{2,3}$')))
                AND list_bool_and(list_transform(codes, lambda x: TRY_CAST(x AS INT) BETWEEN 32 AND 126)))""",
        f"""url_tok AS (SELECT DISTINCT repo, path, file_context, tok FROM (SELECT repo, path, file_context,
              unnest(regexp_extract_all(content, {q(url_pattern())}, 0)) AS tok FROM fm))""",
    ]


def url_pattern() -> str:
    return r"https?://[a-zA-Z0-9.\-_]+(?:/[^" + K.BLANK + r"<>\x22\x27]*)?"


def hits_ctes(rules: dict[str, str] | None = None) -> list[str]:
    """The whole scan as one CTE ``hits``."""
    rules = K.PATTERNS if rules is None else rules
    url_list = lambda: f"unnest(regexp_extract_all(decoded, {q(url_pattern())}, 0)) AS u, generate_subscripts(regexp_extract_all(decoded, {q(url_pattern())}, 0), 1) - 1 AS match_no"

    def urls(source: str, stage: str, ftype: str, label: str, conf: float, once: bool) -> list[str]:
        inner = f"(SELECT repo, path, file_context, mult, pos, {url_list()} FROM {source})"
        return [
            f"""SELECT 'finding' AS row_kind, repo, path AS file, {q(ftype)} AS type, {q(f'Obfuscated URL in {label}: ')} || left(u, 50) || '...' AS description,
                u AS match_content, {clamp(f'CAST({conf} AS DOUBLE) * mult')} AS confidence, file_context, {STAGES.index(stage)} AS stage, -1 AS line_no, pos, 0 AS rule_no,
                match_no, {once} AS once FROM {inner} WHERE {public('u')}""",
            f"""SELECT 'ioc', repo, path, NULL, NULL, u, NULL, file_context, {STAGES.index(stage)}, -1, pos, 0, match_no, {once} FROM {inner} WHERE {public('u')}""",
        ]

    secret_desc = "CASE WHEN type = 'Generic API Key' THEN 'Possible API key.' ELSE 'Possible exposed secret ''' || type || '''' END"
    parts = [
        f"""SELECT 'finding' AS row_kind, repo, path AS file, type, {secret_desc} AS description, match_content, {clamp('raw * mult * damp')} AS confidence,
            file_context, 1 AS stage, line_no, line_no AS pos, rule_no, match_no, type <> 'Generic API Key' AS once FROM secret_scored""",
        f"""SELECT 'finding', repo, path, type, 'Comando suspeito: ''' || type || '''', match_content, {clamp('raw * mult * damp')}, file_context,
            2, line_no, line_no, rule_no, match_no, false FROM suspicious_scored""",
        f"""SELECT 'finding', repo, path, 'Suspicious JS Keyword', 'Suspicious JS keyword ''' || word || '''', t, {clamp('CAST(0.25 AS DOUBLE) * mult * damp')},
            file_context, 0, line_no, line_no, rule_no, 0, true FROM js_raw""",
        f"""SELECT 'finding', repo, path, 'High Entropy String', printf('High entropy string (%.2f)', bits), tok,
            {clamp('least((bits - 5.2) / 2 + 0.3, CAST(0.85 AS DOUBLE)) * mult')}, file_context, 3, -1, pos, 0, 0, true FROM entropy_tok WHERE bits > 5.2""",
        *urls("b64", "base64", "Hidden IOC (Base64)", "Base64", 0.70, True),
        *urls("hexed", "hex", "Hidden IOC (Hex)", "hex", 0.75, False),
        secret_test("decoded", rules, "hex", "hex encoding", "Hidden IOC (Hex)", 0.80, "hexed"),
        f"""SELECT 'finding', repo, path, 'Hidden IOC (URL Encoded)', 'URL-encoded connection string: ' || left(decoded, 60) || '...', decoded,
            {clamp('CAST(0.85 AS DOUBLE) * mult')}, file_context, 6, -1, pos, 0, 0, false FROM dsn""",
        f"""SELECT 'ioc', repo, path, NULL, NULL, u, NULL, file_context, 6, -1, pos, 1, match_no, false FROM
            (SELECT repo, path, file_context, pos, {url_list()} FROM dsn) WHERE {public('u')}""",
        *urls("chars", "chars", "Hidden IOC (Char Array)", "char array", 0.80, False),
        secret_test("decoded", rules, "chars", "char array", "Hidden IOC (Char Array)", 0.85, "chars"),
        f"SELECT 'ioc', repo, path, NULL, NULL, tok, NULL, file_context, 8, -1, 0, 0, 0, true FROM url_tok WHERE {public('tok')}",
    ]
    key = "CASE WHEN row_kind = 'ioc' OR stage = 4 THEN match_content ELSE type || chr(1) || description END"
    return [
        *files_ctes(), *line_ctes(), *rule_cte("secret", rules, K.SECRET), *rule_cte("suspicious", rules, K.SUSPICIOUS),
        *js_cte(), *token_ctes(rules),
        f"all_hits AS ({' UNION ALL '.join(parts)})",
        f"""hits AS MATERIALIZED (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, row_kind, once, {key}
              ORDER BY stage, line_no, pos, rule_no, match_no) AS nth FROM all_hits) WHERE NOT once OR nth = 1)""",
    ]


def triage_ctes() -> list[str]:
    """``triaged``: severity, second look, lift, disposition."""
    uuid = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    return [
        f"""t0 AS (SELECT *, {case_of('type', K.SEVERITY, K.DEFAULT_SEVERITY)} AS severity,
              CASE WHEN type IN ('AWS Key', 'AWS Secret Key') AND {placeholder('match_content')} THEN least(confidence, CAST(0.05 AS DOUBLE))
                   WHEN type = 'High Entropy String' AND regexp_matches(match_content, '{uuid}') THEN least(confidence, CAST(0.05 AS DOUBLE))
                   ELSE confidence END AS c0 FROM hits WHERE row_kind = 'finding')""",
        "t1 AS (SELECT * EXCLUDE (confidence), CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN greatest(c0, CAST(0.7 AS DOUBLE)) ELSE c0 END AS confidence FROM t0)",
        """triaged AS MATERIALIZED (SELECT * REPLACE (CASE WHEN confidence >= 0.7 THEN NULL ELSE match_content END AS match_content),
              CASE WHEN confidence < CAST(0.15 AS DOUBLE) THEN 'discard' WHEN confidence >= 0.7 THEN 'accept' ELSE 'candidate' END AS disposition FROM t1)""",
    ]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
