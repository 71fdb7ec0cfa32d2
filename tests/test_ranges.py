import random

import pytest
from pyspark.sql import functions as F

from glintscan.functions.versions import version_key
from glintscan.operators import lookup, ranges as R

# Versions in the order of their ecosystem; those in one group are equal.
ORDERS = {
    "npm": [["0.9"], ["1.0.0-0"], ["1.0.0-2"], ["1.0.0-10"], ["1.0.0-alpha"], ["1.0.0-alpha.1"], ["1.0.0-alpha.beta"], ["1.0.0-beta.2"], ["1.0.0-beta.11"],
            ["1.0.0-rc.1"], ["1", "1.0.0", "v1.0.0+build.5", "=1.0"], ["1.0.1-rc"], ["1.0.1"], ["1.2.0"], ["1.10.0"], ["10.0.0"], ["20240101000000.0.0"]],
    "PyPI": [["1.0.dev1"], ["1.0a1.dev1"], ["1.0a1", "1.0alpha1", "1.0.a1"], ["1.0a1.post1.dev2"], ["1.0a1.post1"], ["1.0a2"], ["1.0b1", "1.0-beta-1"], ["1.0rc1", "1.0c1"],
             ["1.0", "1", "1.0.0", "1.0+local.7"], ["1.0.post1.dev1"], ["1.0.post1", "1.0-1"], ["1.0.1"], ["1.1.dev3"], ["1.1"], ["2!0.1"]],
    "RubyGems": [["1.0.0.alpha"], ["1.0.0.beta2"], ["1.0.0.beta10"], ["1.0.0.rc1"], ["1.0", "1.0.0"], ["1.0.1"]],
    "Packagist": [["1.0-dev"], ["1.0-alpha1"], ["1.0-beta1"], ["1.0-RC1"], ["v1.0", "1.0.0"], ["1.0-p1"], ["1.0.1"]],
}


@pytest.mark.parametrize("ecosystem", ORDERS)
def test_keys_sort_like_versions(spark, ecosystem):
    rows = [(n, v) for n, group in enumerate(ORDERS[ecosystem]) for v in group]
    keyed = spark.createDataFrame(rows, "n int, v string").withColumn("key", version_key(F.lit(ecosystem), F.col("v"))).collect()
    assert all(r.key for r in keyed)
    for a in keyed:
        for b in keyed:
            assert (a.n < b.n, a.n == b.n) == (a.key < b.key, a.key == b.key), (a.v, b.v)


def test_no_version_has_no_key(spark):
    rows = spark.createDataFrame([(None,), ("",), ("latest",), ("*",), ("v",), ("!",)], "v string")
    assert {r[0] for r in rows.select(version_key(F.lit("PyPI"), F.col("v"))).collect()} == {None}


def test_blocks_cover_each_number_once(spark):
    pairs = [(lo, hi) for lo in range(20) for hi in range(lo, 21)] + [(0, 1 << 30), ((1 << 30) - 3, (1 << 30) + 5), (7, 8)]
    df = spark.createDataFrame(pairs, "lo bigint, hi bigint").select("lo", "hi", R.blocks(F.col("lo"), F.col("hi")).alias("b"))
    for r in df.collect():
        spans = sorted((b.block << b.level, (b.block + 1) << b.level) for b in r.b)
        assert len(spans) <= 62 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (r.lo, r.hi) if r.lo < r.hi else spans == []


def test_ranges_equal_brute_force(spark):
    """Many overlapping ranges, one package with a third of all rows, repeated rows, and bounds that are not in use."""
    rng = random.Random(3)
    text = lambda: f"{rng.randrange(6)}.{rng.randrange(12)}"
    name = lambda: "hot" if rng.random() < 0.33 else f"p{rng.randrange(5)}"
    versions = [("npm", name(), text()) for _ in range(300)]
    ranges = [("npm", name(), rng.choice([text(), None, "0"]), rng.choice([text(), None]), rng.choice([text(), None]), f"id{i % 190}") for i in range(200)]
    ranges += ranges[:5] + [("npm", "hot", "no version", "9", None, "bad"), ("npm", "hot", "5", "5", None, "empty"), ("PyPI", "hot", "0", None, None, "other")]
    got = R.affected(spark.createDataFrame(versions, "ecosystem string, name string, version string"), spark.createDataFrame(
        ranges, "ecosystem string, name string, introduced string, fixed string, last_affected string, id string")).collect()
    num = lambda v: tuple(map(int, v.split("."))) if "." in v else (int(v), 0)
    want = set()
    for e, n, v in versions:
        for re_, rn, lo, hi, last, i in ranges:
            if (e, n) != (re_, rn) or lo == "no version" or (lo and num(v) < num(lo)):
                continue
            if (hi and num(v) < num(hi)) or (not hi and last and num(v) <= num(last)) or (not hi and not last):
                want.add((e, n, v, i))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500


def test_findings_of_ranges(spark):
    deps = spark.createDataFrame([("r", "requirements.txt", "a", "1.4rc1"), ("r", "requirements.txt", "a", "1.4"), ("r", "requirements.txt", "b", ""), ("r", "x", "a", "1")],
                                 "repo string, manifest string, name string, version string")
    ranges = spark.createDataFrame([("PyPI", "a", "1.0", "1.4", "GHSA-1"), ("PyPI", "a", None, None, "MAL-2"), ("PyPI", "b", "3", "4", "GHSA-3")],
                                   "ecosystem string, name string, introduced string, fixed string, id string")
    got = {(r.file, r.type, r.description) for r in R.range_findings(deps, ranges).collect()}
    assert got == {("requirements.txt", "Vulnerable Dependency", "Dependencia vulneravel: 'a' (IDs: GHSA-1)"),
                   ("requirements.txt", "Malicious Dependency", "Dependencia maliciosa: 'a' (IDs: MAL-2)"),
                   ("requirements.txt", "Vulnerable Dependency", "Dependencia vulneravel: 'b' (IDs: GHSA-3)")}
    empty = ranges.where("false")
    assert R.range_findings(deps, empty).count() == 0 and R.range_findings(deps.where("false"), ranges).count() == 0
    plan = R.affected(deps.selectExpr("'PyPI' AS ecosystem", "name", "version"), ranges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dependencies_are_made_once(spark):
    """Whatever the manifests cost to parse, they cost it once."""
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("r", "requirements.txt", f"p{i % 3}", f"1.{i}") for i in range(20)] + [("r", "requirements.txt", "p0", "")]
    schema = "repo string, manifest string, name string, version string"
    deps = lambda: spark.createDataFrame(rows, schema).mapInArrow(passed, schema)
    ranges = spark.createDataFrame([("PyPI", "p0", "1.0", "1.9", "GHSA-1"), ("PyPI", "p1", None, None, "MAL-2")],
                                   "ecosystem string, name string, introduced string, fixed string, id string")
    assert R.range_findings(deps(), ranges).count() == 2 and made.value == len(rows)
    listed = ranges.selectExpr("ecosystem", "name", "array('1.0', '1.3') AS versions", "id")
    assert lookup.vulnerable_dependencies(deps(), listed).count() == 1 and made.value == 2 * len(rows)
