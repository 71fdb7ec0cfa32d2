"""Dependencies and scripts from package manifests.

``files(repo, path, name, content)`` → one pass over the manifest files.  JSON
formats become package rows at once; line formats keep only the lines that
matter, so the one window by file moves a few short lines per package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glintscan import catalogue as K
from glintscan.functions.text import clean_version
from glintscan.sqltext import FLAGS, blank_trim

OUT = ["repo", "path", "manifest", "name", "version"]
ROWS = "array<struct<kind:string,line_no:int,name:string,version:string,line:string>>"
JSON_FORMATS = ["package.json", "package-lock.json", "Pipfile.lock", "composer.lock"]
LINE_FORMATS = ["yarn.lock", "requirements.txt", "Cargo.lock", "go.sum", "Gemfile.lock", "pyproject.toml"]
NAMES = JSON_FORMATS + LINE_FORMATS
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def manifest_files(files: DataFrame) -> DataFrame:
    """Name filter first: the content of other files is never decoded."""
    return files.where(F.col("name").isin(NAMES)).select(
        "repo", "path", F.col("name").alias("manifest"), "content"
    )


# --- JSON formats ----------------------------------------------------------
def _string(v: Column) -> Column:
    """A VARIANT that is a JSON string, as text; otherwise NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _field(v: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))


def _entries(doc: Column, key: str) -> Column:
    """Members of an object as ``array<struct<key, value>>``; empty when there is none."""
    return F.map_entries(F.coalesce(
        F.try_variant_get(doc, f"$['{key}']", "map<string,variant>"), F.create_map().cast("map<string,variant>")))


def _items(doc: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, f"$['{key}']", "array<variant>"), F.array().cast("array<variant>"))


def _row(kind: str, name: Column, version: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("line_no"), name.alias("name"),
                    version.alias("version"), F.lit(None).cast("string").alias("line"))


def _rows(kind: str, entries: Column, name, version) -> Column:
    return F.transform(entries, lambda e: _row(kind, name(e), version(e))).cast(ROWS)


def json_rows(doc: Column) -> Column:
    key = lambda e: e["key"]
    declared = F.concat(_entries(doc, "dependencies"), _entries(doc, "devDependencies"))
    packages = _entries(doc, "packages")
    locked = F.filter(
        F.when(F.size(packages) > 0, packages).otherwise(_entries(doc, "dependencies")),
        lambda e: F.startswith(F.schema_of_variant(e["value"]), F.lit("OBJECT"))
        & (blank_trim(F.replace(e["key"], F.lit("node_modules/"), F.lit(""))) != ""),
    )
    composed = F.filter(F.concat(_items(doc, "packages"), _items(doc, "packages-dev")), lambda v: _field(v, "name") != "")
    manifest = F.col("manifest")
    return (
        F.when(manifest == "package.json", F.concat(
            _rows("package", declared, key, lambda e: F.coalesce(clean_version(_string(e["value"])), F.lit(""))),
            _rows("script", _entries(doc, "scripts"), key, lambda e: _string(e["value"]))))
        .when(manifest == "package-lock.json", _rows(
            "package", locked, lambda e: blank_trim(F.replace(e["key"], F.lit("node_modules/"), F.lit(""))),
            lambda e: _field(e["value"], "version")))
        .when(manifest == "Pipfile.lock", _rows(
            "package", F.concat(_entries(doc, "default"), _entries(doc, "develop")), key,
            lambda e: F.ltrim(_field(e["value"], "version"), F.lit("="))))
        .when(manifest == "composer.lock", _rows(
            "package", composed, lambda v: _field(v, "name"), lambda v: F.ltrim(_field(v, "version"), F.lit("v"))))
    )


# --- line formats ----------------------------------------------------------
OPERATOR = "[><=!~]+"


def requirement(text: Column) -> tuple[Column, Column]:
    """Package and version around the first run of operators."""
    package = blank_trim(F.regexp_replace(text, rf"(?s){OPERATOR}.*\z", ""))
    version = F.ltrim(blank_trim(F.regexp_extract(text, rf"(?s){OPERATOR}(.*)\z", 1)), F.lit("="))
    return package, version


def _quoted(line: Column) -> Column:
    return F.coalesce(F.split_part(line, F.lit('"'), F.lit(2)), F.lit(""))


def line_rows(content: Column) -> Column:
    return F.transform(
        F.split(content, LINE_BREAK),
        lambda line, i: F.struct(F.lit("line").alias("kind"), i.cast("int").alias("line_no"),
                                 F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"),
                                 line.alias("line")),
    ).cast(ROWS)


def _paired_formats(manifest: Column, line: Column, text: Column) -> tuple[Column, Column]:
    """Name lines (with the package) and version lines of yarn.lock and Cargo.lock."""
    header = (line != "") & ~F.startswith(line, F.lit(" ")) & ~F.startswith(line, F.lit("#"))
    yarn_name = blank_trim(F.btrim(F.split_part(line, F.lit("@"), F.lit(1)), F.lit('"')))
    package = F.when((manifest == "yarn.lock") & header, yarn_name).when(
        (manifest == "Cargo.lock") & F.startswith(text, F.lit("name = ")), _quoted(text))
    version = F.when(package.isNull() & (
        ((manifest == "yarn.lock") & F.startswith(text, F.lit("version ")))
        | ((manifest == "Cargo.lock") & F.startswith(text, F.lit("version = ")))), _quoted(line))
    return package, version


def marked_lines(rows: DataFrame) -> DataFrame:
    """Per line: what it says about itself and about the lines after it."""
    manifest, line = F.col("manifest"), F.col("line")
    text = blank_trim(line)
    package, pair_version = _paired_formats(manifest, line, text)
    outdented = ~F.startswith(line, F.lit(" "))
    specs = F.when(manifest == "Gemfile.lock", F.when(text == "specs:", "on").when(
        outdented & ((text == "") | F.startswith(text, F.lit("("))), "off"))
    toml = (manifest == "pyproject.toml") & (text != "") & ~F.startswith(text, F.lit("#"))
    header = F.when(toml, F.nullif(F.regexp_extract(text, r"^\[([^\[\]]+)\]", 1), F.lit("")))
    key = F.when(toml, F.regexp_extract(text, r"""^["']?([A-Za-z0-9_.-]+)["']?\s*=""", 1))
    opens = F.when(toml & F.rlike(text, F.lit(r"^[^=]+=\s*\[")), key)
    closes = toml & F.contains(F.regexp_replace(text, r'"[^"]*"|\'[^\']*\'', ""), F.lit("]"))
    wanted = (
        (F.col("kind") != "line") | package.isNotNull() | pair_version.isNotNull()
        | ((manifest == "Gemfile.lock") & ((text != "") | outdented)) | toml
        | ((manifest == "requirements.txt") & (text != "") & ~F.startswith(text, F.lit("#")) & ~F.startswith(text, F.lit("-")))
        | ((manifest == "go.sum") & F.rlike(text, F.lit(rf"[{K.BLANK}]")))
    )
    return rows.where(wanted).select(
        "repo", "path", "manifest", "kind", "line_no", "name", "version", text.alias("text"), package.alias("package"),
        pair_version.alias("pair_version"), specs.alias("specs"), header.alias("header"), key.alias("key"), opens.alias("opens"),
        F.when(header.isNotNull(), "").when(opens.isNotNull() & ~closes, opens).when(closes, "").alias("array_event"),
    )


def manifest_rows(files: DataFrame) -> DataFrame:
    """``(repo, path, manifest, kind, name, version)``; kind is ``package`` or ``script``.

    Files are dealt out by name before they are parsed: a small file of a packed table holds a great many manifests, and
    the windows by file need the same layout.
    """
    manifests = manifest_files(files).repartition("repo", "path", "manifest")
    is_json = F.col("manifest").isin(JSON_FORMATS)
    parsed = manifests.select("repo", "path", "manifest", "content", F.when(is_json, F.try_parse_json("content")).alias("doc"))
    rows = parsed.select("repo", "path", "manifest", F.inline(
        F.when(is_json, json_rows(F.col("doc"))).otherwise(line_rows(F.col("content")))))
    by_file = Window.partitionBy("repo", "path", "manifest").orderBy("line_no")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    seen = (
        marked_lines(rows)
        .withColumn("above", F.lag("package").over(by_file))
        .withColumn("in_specs", last("specs", before) == "on")
        .withColumn("section", last("header", by_file))
        .withColumn("open_key", F.coalesce(last("array_event", before), F.lit("")))
    )
    text, manifest, section, key = F.col("text"), F.col("manifest"), F.col("section"), F.col("key")
    array_key = F.when(F.col("open_key") != "", F.col("open_key")).otherwise(F.col("opens"))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(r'"([^"]*)"|\'([^\']*)\''), F.lit(0)),
                         lambda q: F.regexp_replace(q, r"""^["']|["']\z""", ""))
    optional = section == "project.optional-dependencies"
    poetry, dev = section == "tool.poetry.dependencies", section == "tool.poetry.dev-dependencies"
    value = F.regexp_extract(text, r"""=\s*["']([^"']*)["']""", 1)
    in_table = F.regexp_extract(text, r"""[{,]\s*version\s*=\s*["']([^"']*)["']""", 1)
    is_table = F.rlike(text, F.lit(r"=\s*\{"))
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("version"))

    def listed(q: Column) -> Column:
        package, version = requirement(q)
        return pair(F.split_part(package, F.lit("["), F.lit(1)), F.when(optional, "").otherwise(version))

    toml = F.when(F.col("header").isNotNull(), F.array().cast("array<struct<name:string,version:string>>")).when(
        ((section == "project") & (array_key == "dependencies")) | (optional & (F.coalesce(array_key, F.lit("")) != "")),
        F.transform(quoted, listed),
    ).when(
        (poetry | dev) & (key != "") & (F.col("open_key") == "") & (dev | (F.lower("key") != "python")),
        F.array(pair(key, clean_version(F.when(is_table, F.when(poetry, in_table).otherwise("")).otherwise(value)))),
    )
    requested = requirement(F.regexp_replace(
        blank_trim(F.split_part(text, F.lit(";"), F.lit(1))), r"\[.*?\]", ""))
    words = F.split(text, rf"[{K.BLANK}]+")
    gem = rf"^([^{K.BLANK}]+)[{K.BLANK}]*\(([^)]+)\)"
    gem_name = F.when(F.rlike(text, F.lit(gem)), F.regexp_extract(text, gem, 1)).otherwise(
        blank_trim(F.split_part(text, F.lit("("), F.lit(1))))
    found = (
        F.when(F.col("kind") != "line", F.array(pair(F.col("name"), F.col("version"))))
        .when(manifest.isin("yarn.lock", "Cargo.lock"), F.when(
            F.col("pair_version").isNotNull(), F.array(pair(F.col("above"), F.col("pair_version")))))
        .when(manifest == "requirements.txt", F.array(pair(*requested)))
        .when(manifest == "go.sum", F.array(pair(
            words[0], F.ltrim(F.split_part(words[1], F.lit("/"), F.lit(1)), F.lit("v")))))
        .when(manifest == "Gemfile.lock", F.when(
            F.col("in_specs") & F.col("specs").isNull() & (text != "") & ~F.startswith(text, F.lit("(")),
            F.array(pair(gem_name, F.regexp_extract(text, gem, 2)))))
        .when(manifest == "pyproject.toml", toml)
    )
    out = seen.select(
        "repo", "path", "manifest", F.when(F.col("kind") == "script", "script").otherwise("package").alias("kind"),
        "line_no", F.inline(found),
    ).where((F.coalesce("name", F.lit("")) != "") | (F.col("manifest").isin(JSON_FORMATS)))
    # go.sum names every module twice: the first line counts
    once = Window.partitionBy("repo", "path", "manifest", "name").orderBy("line_no")
    return (
        out.withColumn("nth", F.when(F.col("manifest") == "go.sum", F.row_number().over(once)).otherwise(1))
        .where("nth = 1").drop("nth", "line_no")
    )


def packages_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'package'").select(*OUT)


def dependencies(files: DataFrame) -> DataFrame:
    return packages_of(manifest_rows(files))


def merged_dependencies(deps: DataFrame) -> DataFrame:
    """Distinct packages per repository and manifest name, over all directories."""
    return deps.select("repo", "manifest", "name", "version").distinct()


def ordered_dependencies(deps: DataFrame) -> DataFrame:
    """Adds ``position``: the place by name and version within the manifest kind of a repository."""
    order = Window.partitionBy("repo", "manifest").orderBy("name", "version")
    return deps.select("repo", "manifest", F.row_number().over(order).cast("long").alias("position"), "name", "version")


def hook_findings() -> Column:
    """Findings of one script row: a lifecycle script, and a download piped into a shell."""
    hook = F.when(F.col("name").isin(K.NPM_LIFECYCLE_HOOKS), F.struct(
        F.lit(K.SEVERITY.get("NPM Dangerous Hook", "CRITICAL")).alias("severity"),
        F.concat(F.lit("Hook de NPM perigoso ('"), F.col("name"), F.lit("')")).alias("description"),
        F.lit("NPM Dangerous Hook").alias("type"),
    ))
    pipe = F.when(F.rlike(F.col("version"), F.lit(FLAGS + K.NPM_PIPE_TO_SHELL)), F.struct(
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Script NPM com pipe remoto para shell ('"), F.col("name"), F.lit("')")).alias("description"),
        F.lit("Remote Code Loading").alias("type"),
    ))
    return F.filter(F.array(hook, pipe), lambda h: h.isNotNull())


def hooks_of(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'script'").select("repo", F.col("path").alias("file"), F.inline(hook_findings()))


def npm_hooks(files: DataFrame) -> DataFrame:
    return hooks_of(manifest_rows(files))
