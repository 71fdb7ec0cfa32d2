"""Fill-in-the-middle forms against a plain cut of every text."""

import hashlib
import re

from glintscan.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42):
    text = text or ""
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df):
    got = fim.fill_in_middle(df).withColumn("again", fim.restored()).collect()
    rows = df.select("doc_id", "text").collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (plain(*r) for r in rows)))
    assert sorted(r.again for r in got) == sorted(r.text or "" for r in rows)
    return got


def test_odd_texts(table):
    odd = ["", None, " ", "\n\t\x0b", "one", "two words", " lead", "trail \n", "a\x00b \x1c c", "é è ü x 😀 y", "<P> x", "a <M> b", "a <S", "<<P", "P> <S", "<", ">" * 5]
    rows = [(100 * k + i, t) for i, t in enumerate(odd) for k in range(30)] + [(None, "null id here"), (None, "null id here"), (7, "same id"), (7, "same id, other text")]
    got = check(table(rows, "doc_id long, text string"))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(table([], "doc_id long, text string")).collect() == []
    assert check(table([(1, None), (2, None)], "doc_id int, text string"))


def test_long_texts_and_portions(table, monkeypatch):
    rows = [(i, "wörd " * n) for i, n in enumerate([3_000_000, 0, 1, 400_000, 2, 2_000_000, 5])]
    check(table(rows, "doc_id long, text string"))


def test_documents(documents):
    assert len(check(documents)) == documents.count()


def test_seed_and_shares(table):
    df = table([(i, "a b c d e f") for i in range(2_000)], "doc_id long, text string")
    forms = [r.form for r in fim.fill_in_middle(df, seed=1, plain_percent=10, spm_percent=0).collect()]
    assert 0.05 < forms.count("plain") / 2_000 < 0.15 and "spm" not in forms
