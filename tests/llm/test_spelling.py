"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import numpy as np

from glintscan.llm import queries, spelling

WORDS = "word string, n long"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, factor=5):
    by_length = collections.defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    forms, rows = {}, {}
    for w, n in counts.items():
        around = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= factor * n else None
        rows[w] = len(around)

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return sorted((w, str(forms[w]), root(w), n, rows[w], str(counts.get(forms[w]))) for w, n in counts.items())


def shown(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def vocabulary(rng, size):
    counts = {}
    while len(counts) < size:
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 8)))
        counts[w] = rng.choice([5, 5, 6, 7, 30, 40, 200, 1_001, 5_005])
    for w in list(counts)[:size // 3]:
        i = rng.randrange(len(w))
        for x in (w[:i] + w[i + 1:], w[:i] + "ÿ" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i] + w[i:]):
            counts.setdefault(x, rng.choice([5, 6, 25, 125, 625]))
    return counts


def test_against_all_pairs(table):
    rng = random.Random(4)
    counts = vocabulary(rng, 900)
    counts |= {"a" * 200: 5, "a" * 199: 30, "a" * 198 + "b": 200, "x" * 63: 5, "x" * 64: 26, "x" * 65: 200, "aaaaaaa": 9, "÷×÷×÷×": 7, "÷×÷×÷": 50}
    got = shown(spelling.variants(table(list(counts.items()), WORDS)))
    want = plain(counts)
    assert got == want
    assert sum(r[4] > 1 for r in want) > 200 and any(r[1] != "None" and r[2] != r[1] for r in want)


def test_full_filter_loses_nothing(table, monkeypatch):
    """At the bound of its size the filter lets nearly everything pass; the join still gives the same words."""
    monkeypatch.setattr(spelling, "MAX_BITS", 256)
    counts = vocabulary(random.Random(5), 120)
    assert shown(spelling.variants(table(list(counts.items()), WORDS))) == plain(counts)


def test_empty_and_single(table):
    assert spelling.variants(table([], WORDS)).collect() == []
    assert shown(spelling.variants(table([("lonely", 5)], WORDS))) == [("lonely", "None", "lonely", 5, 0, "None")]
    assert spelling.vocabulary(table([], "doc_id long, text string")).collect() == []


def counted(rows, every):
    out = collections.Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 6:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 5}


def test_vocabulary(table, documents, monkeypatch):
    rows = [(i, "Étude étude ÉTUDE-lettre planets PLANETS' naïveté x12planets " * 3) for i in range(400)] + [(None, "planets planet " * 9), (1, None), (2, ""), (3, "longword" * 4_000 + " Longword " * 6)]
    df = table(rows, "doc_id long, text string")
    for every in (None, 7):
        assert {r.word: r.n for r in spelling.vocabulary(df, typo_every=every).collect()} == counted(rows, every)
    monkeypatch.setattr(spelling, "SLICE", 37)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == counted(rows, None)


def test_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert shown(queries.op11_spelling(spark, "/root/testdata/sf0.001")) == plain(counted(rows, 199))


def test_hash_of_edits():
    """The hash of an edit equals that of the edited word, and every word passes the filter of its length."""
    word, plan = "spelling", spelling.layout({7: 1, 8: 30})
    code = lambda w: np.array([[ord(c) for c in w]], np.uint64)
    lanes = np.zeros((int(plan.blocks.sum()), spelling.LANES), np.uint32)
    other = ["spellin", "spellizg", "zpelling", "pelling"]
    for w in other:
        block, number = spelling.places(spelling.prefix_sums(code(w))[:, -1], len(w), plan)
        for k in range(spelling.LANES):
            lanes[block, k] |= spelling.lane_bit(number, k)
    found = {word[:i] + (chr(c) if c else "") + word[i + 1:] for _, i, c in spelling.edits(code(word), np.array([ord("z")], np.uint64), plan, lanes)}
    assert set(other) <= found
