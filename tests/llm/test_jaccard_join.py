"""The Jaccard join against all pairs."""

import itertools
import random

import numpy as np
import pytest

from glintscan.llm import jaccard_join as jj
from glintscan.llm.shingle_sets import bitmap, mixed

DOCS = "doc_id long, text string"
SPACES = " \t\n\x0b\x0c\r"


def ngrams(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES:
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain(rows, width=jj.WIDTH, percent=jj.PERCENT):
    """Component of every id, and the links between smallest ids of different sets."""
    sets = [(i, ngrams(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = set()
    rep = {}
    for i, s in sorted(sets, key=lambda x: x[0]):
        rep.setdefault(s, i)
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        common = len(a & b)
        if a and b and 100 * common >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
            if a != b:
                found.add((*sorted((rep[a], rep[b])), common))
    return {i: root(i) for i in parent}, found


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(size)]
    for _ in range(rng.randint(1, 9)):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(text))
            if rng.random() < 0.3:
                del text[k]
            else:
                text[k] = rng.choice(words)
            if not text:
                break
        yield " ".join(text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3_000)]
    texts = [t for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 22, 27, 33, 40, 50, 64, 90, 140, 250, 400] for _ in range(4) for t in family(rng, words, size, size // 12 + 1)]
    few = words[:6]  # texts of few words, so that small sets share much
    texts += [" ".join(rng.choice(few) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += [None, "", " \n", "A b C d e", "a B c D e", "same words", "same  WORDS", "é É é É é", *["w " * n for n in range(1, 12)]]
    texts += ["hot " * 4 + " ".join(words[k:k + 60]) for k in range(40)]
    return list(enumerate(texts, 5))


def test_against_all_pairs(rows, table):
    extra = [(None, "a b c d e"), (None, None), (9_000, rows[7][1]), (9_000, rows[100][1]), (9_000, rows[100][1]), rows[3], rows[3], (3, rows[50][1])]
    df = table(rows + extra, DOCS)
    want, _ = plain(rows + extra)
    got = jj.join(df).collect()
    assert len(got) == len(rows + extra)
    assert sorted(r.n_shingles for r in got) == sorted(len(ngrams(t, 4)) for _, t in rows + extra)
    assert {r.doc_id: r.component_id for r in got} == {None: None} | want
    assert len(set(want.values())) < len(want) - 100


def test_every_link(rows, table):
    assert {tuple(r) for r in jj.pairs(table(rows, DOCS)).collect()} == plain(rows)[1]
    assert {tuple(r) for r in jj.pairs(table(rows, DOCS), width=2, percent=60).collect()} == plain(rows, 2, 60)[1]


def test_blocks_of_large_tiles(rows, table, monkeypatch):
    """A tile larger than a block is compared block by block; the labels leave enough to compare."""
    monkeypatch.setattr(jj, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"x{k}" for k in range(120)]
    copies = []
    for i in range(120):  # two of them differ in up to twice what each differs from the base
        text = list(base)
        for _ in range(2):
            text[rng.randrange(120)] = f"y{i}"
        copies.append((10_000 + i, " ".join(text)))
    every = rows[:200] + copies + [(20_000, " ".join(base))]
    got = {r.doc_id: r.component_id for r in jj.join(table(every, DOCS)).collect()}
    assert got == plain(every)[0]
    assert {tuple(r) for r in jj.pairs(table(every, DOCS)).collect()} == plain(every)[1]


def test_empty_and_long(table):
    assert jj.join(table([], DOCS)).collect() == []
    rng = random.Random(1)
    words = [f"{rng.getrandbits(30):x}" for _ in range(300_000)]
    other = list(words)
    for k in range(0, len(other), 60):
        other[k] = "changed"
    far = list(words)
    for k in range(0, len(far), 20):
        far[k] = "changed"
    got = jj.join(table([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, "short")], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_bounds():
    """Bitmaps never differ in more bits than their sets in elements, and linked sets share a part."""
    rng = np.random.default_rng(2)
    table = jj.bands(85)
    assert all(b.high + 1 == c.low and b.guests >= b.high and b.parts > b.spare for b, c in itertools.pairwise(table))
    for _ in range(400):
        n = int(rng.integers(6, 300))
        a = np.unique(mixed(rng.integers(0, 2**62, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.07], mixed(rng.integers(0, 2**62, int(rng.integers(0, 8))).astype(np.uint64))]))
        differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert np.bitwise_count(bitmap(a, 256) ^ bitmap(b, 256)).sum() <= differ
        if len(b) and jj.similar_enough(differ, len(a) + len(b), 85):
            small, large = sorted((len(a), len(b)))
            number = next(k for k, x in enumerate(table) if x.low <= small <= x.high)
            assert large <= table[number].guests
            shared = [set(jj.part_hashes(x, table[number].parts, table[number].spare, number).tolist()) for x in (a, b)]
            assert shared[0] & shared[1]


@pytest.mark.parametrize("size", [3000, 9000])
def test_large_unlike_sets_of_a_tile_are_no_candidates(spark, size):
    """However large the sets are, the bitmaps in a tile tell unlike ones apart, and leave like ones."""
    rng = random.Random(size)
    texts = [" ".join(str(rng.randrange(10**9)) for _ in range(size)) for _ in range(4)]
    rows = list(enumerate([*texts, texts[0] + " more"]))
    placed = jj.sketch(spark.createDataFrame(rows, DOCS), jj.WIDTH, jj.PERCENT).selectExpr("doc_id AS doc", "doc_id AS label", "n_shingles AS n", "inline(places)")
    met = jj.candidates(placed.selectExpr("1L AS unit", "*"), jj.PERCENT, closest=False)
    assert {(r.a, r.b) for r in met.collect()} == {(0, 4)}
