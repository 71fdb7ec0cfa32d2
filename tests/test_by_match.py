from glintscan.operators import dedup, detect, triage

LONG = "http://evil-host.net/" + "a" * 60


def test_hidden_urls_with_equal_beginnings_stay_apart(spark, files):
    """Two URLs equal in their first 50 characters are two findings by match, with their own files and counts."""
    codes = lambda url: "var c = [" + ", ".join(str(ord(c)) for c in url) + "];\n"
    corpus = files({"src/a.js": codes(LONG + "/one"), "src/b.js": codes(LONG + "/two"), "src/c.js": codes(LONG + "/one")})
    found = detect.findings_of(detect.hits(corpus)).where("type = 'Hidden IOC (Char Array)'")
    kept = triage.accepted(triage.triage(found, keep_match=True))
    got = {(r.dedup_key[-3:], r.file, r.occurrence_count) for r in dedup.deduplicate(kept, by="match").collect()}
    assert got == {("one", "src/a.js", 2), ("two", "src/b.js", 1)}
    places = {(r.dedup_key[-3:], r.file, r.hits) for r in dedup.finding_locations(kept, by="match").collect()}
    assert places == {("one", "src/a.js", 1), ("one", "src/c.js", 1), ("two", "src/b.js", 1)}
    assert dedup.deduplicate(triage.accepted(triage.triage(found))).count() == 1
