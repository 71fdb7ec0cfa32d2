"""Web archives and vector search against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintscan.llm import queries, top_k, warc

PAGES = "page_id long, url string, html string"
TRAP = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60
ROWS = [(1, "http://a.b/c?d#e", TRAP), (2, None, TRAP), (3, "bad\r\nX: y", TRAP), (3, "http://a", None), (4, "u", ""), (4, "u", ""), (None, "q", TRAP),
        (5, "é", "é" * 600), (6, "é", "é" * 600), (6, "é", "é" * 600), (7, "http://x", "short"), (8, "http://x", "short"), (9, "z", "long " * 40_000)]


def digests(captures):
    page = lambda part: F.get_json_object(f"{part}.fields_json", "$.page-id").cast("long")
    rows = captures.select(page("metadata"), "response.payload_bytes", "response.payload_digest", "response.record_type", page("original_metadata"))
    return sorted(map(tuple, rows.collect()), key=str)


def plain(rows):
    holders = collections.defaultdict(list)
    for i, _, html in rows:
        if i is not None:
            holders[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max(holders[html or ""], default=None)
        again = len(data) >= 1_000 and i is not None and i < last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_archives(spark, table, tmp_path):
    pages = table(ROWS, PAGES)
    assert digests(warc.archive(pages)) == plain(ROWS)
    assert warc.archive(pages.limit(0)).collect() == []
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder)
    records = warc.read_archives(spark, folder)
    assert collections.Counter(r.record_type for r in records.collect())["request"] == len(ROWS)
    kept = {bytes(r.payload).decode() for r in records.filter("record_type = 'response'").collect()}
    assert kept == {h or "" for _, _, h in ROWS}
    assert warc.orphans(records).collect() == []
    lost = records.filter("record_type <> 'response'")
    assert {r.record_type for r in warc.orphans(lost).collect()} == {"request", "metadata"}
    bare = warc.assemble(records.filter("record_type = 'response'")).collect()
    assert all(r.request is None and r.metadata is None for r in bare) and len(bare) == sum(x[3] == "response" for x in plain(ROWS))
    one = next(r for r in warc.assemble(records).collect() if r.response.target_uri == "http://a.b/c?d#e")
    assert one.request.target_uri == "http://a.b/c?d#e" and one.response.fields["content-type"].startswith("text/html")


def test_pages(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op3_warc(spark, folder).collect()), key=str) == plain(rows)


def test_foreign_archives():
    import gzip

    def member(kind, extra, block):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    members = [member("warcinfo", "Content-Type: application/warc-fields\r\n", b"software: x\r\n"),
               member("response", "WARC-Record-ID: <a>\r\nContent-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\x00body")]
    content = b"".join(gzip.compress(m) for m in members)
    rows = [warc.parsed(*r) for r in warc.records_of(warc.unzipped(content))]
    assert [r[0] for r in rows] == ["warcinfo", "response"] and rows[1][8] == b"\xff\x00body" and rows[1][5] == [("x", "y")]
    assert warc.hex_digest("sha1:" + "A" * 32) == "0" * 40 and warc.hex_digest(None) is None
    with pytest.raises(ValueError):
        list(warc.records_of(b"no archive\r\n\r\n"))


def best(rows, k=5):
    """Query, rank, id and score by full scores of all rows."""
    fit = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fit), default=0)
    fit = [(i, np.concatenate([v, np.zeros(width - len(v))])) for i, v in fit]
    out, done = [], set()
    for q, v in fit:
        if q % 50 or (q, tuple(v)) in done:
            continue
        done.add((q, tuple(v)))
        scored = sorted((-int(v @ w), i) for i, w in fit if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def answers(df, **options):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.search(df, **options).collect())


@pytest.mark.parametrize("block, query_block", [(4_096, 2_048), (64, 3)])
def test_top_k(table, block, query_block):
    rng = np.random.default_rng(block)
    middles = rng.normal(size=(8, 16))
    vectors = middles[rng.integers(0, 8, 700)] + rng.normal(size=(700, 16)) * 0.3
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1_000, rows[0][1]), (1_001, rows[0][1]), (1_001, rows[0][1]), (1_050, [0.0] * 16), (2_000, None), (2_001, [None] * 16), (2_050, [float("nan")] + [0.0] * 15),
             (2_002, [float("inf")] * 16), (None, rows[0][1]), (2_100, []), (2_003, [1.0, 2.0])]
    df = table(rows, "vec_id long, embedding array<float>")
    assert answers(df, block=block, query_block=query_block) == best(rows)
    assert answers(df.limit(0)) == [] and answers(df.filter("vec_id = 50")) == []
    assert answers(df.filter("vec_id IN (50, 3, 4)")) == best([r for r in rows if r[0] in (50, 3, 4)])


def test_the_search_stops_early():
    """On lists that fall off quickly, most candidates are never scored."""
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.pareto(1.2, size=(4_000, 3)) * 100)
    part = top_k.Block(np.arange(4_000), vectors)
    met = []
    part.exact = Watched(part.exact, met)
    got = part.search(-1, np.array([1.0, 2.0, 1.0]), 5)
    scores = vectors @ np.array([1.0, 2.0, 1.0])
    assert got == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(4_000), -scores))[:5]]
    assert sum(met) < 1_000


class Watched:
    def __init__(self, values, met):
        self.values, self.met = values, met

    def __getitem__(self, at):
        if not isinstance(at, tuple):
            self.met.append(len(at))
        return self.values[at]
