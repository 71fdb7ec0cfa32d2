"""The parts of the near-duplicate operator that work on the rows of nodes, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from glintscan.llm import near_dedup

ODD = ["", " ", "\n a\t", "A b", "\x1ca \x0bb\x0c c\rd", "É x y Z ß", "a a a a a a a a a", "The THE", "one two three four five", " one two three four five six ", "x y\xa0z w", "\x00 a"]


def texts_of(seed, n, words=90, changes=9):
    """Edits of one text, some of which are 75 % alike and some not."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"z{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def plain_shingles(text):
    """The definition, word by word."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    width, full, out = min(len(words), near_dedup.SHINGLE), 2**64 - 1, set()
    for i in range(len(words) - width + 1 if words else 0):
        h = width
        for k in range(width):
            h = ((h ^ (h >> 31)) * int(near_dedup.POWERS[k]) + words[i + k]) & full
        out.add(((h ^ (h >> 32)) * int(near_dedup.POWERS[0])) & full)
    return sorted(out)


def node_rows(node, texts, labels, tree):
    """Members of a node; without a tree they come from large nodes."""
    rows = []
    for i, text in enumerate(texts):
        values = np.array(plain_shingles(text), np.uint64)
        least = (values[:, None] * near_dedup.MULTIPLIERS).min(axis=0)
        tokens = (least ^ (least >> np.uint64(31))).astype("<u2", casting="unsafe")
        roots = (least[:near_dedup.TREES] >> np.uint64(20)).astype(np.uint16, casting="unsafe").view(np.int16)
        if tree is not None:
            tokens[tree] = roots[tree] = 7  # the token that makes the node
        rows.append({
            "node": node, "rep": 1_000 * node + i, "label": labels[i], "tokens": tokens.tobytes(), "tree": tree, "roots": None if tree is None else roots.tolist(),
            "small_in": 0 if tree is None else 0b1011 | 1 << tree, "shingles": values.tobytes()})
    return rows


SCHEMA = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("label", pa.int64()), ("tokens", pa.binary()), ("tree", pa.int32()), ("roots", pa.list_(pa.int16())), ("small_in", pa.int32()), ("shingles", pa.binary())])


def batch_of(rows):
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def alike(x, y):
    x, y = (set(np.frombuffer(r["shingles"], "<u8").tolist()) for r in (x, y))
    return 4 * len(x & y) >= 3 * len(x | y)


def met_earlier(x, y):
    """Whether two members share the root of a tree before theirs, in which their node is small."""
    s, t = (np.frombuffer(r["tokens"], "<u2") for r in (x, y))
    return any(x["small_in"] >> k & 1 and s[k] == t[k] and x["roots"][k] == y["roots"][k] for k in range(x["tree"] or 0))


def plain_pairs(rows):
    for x, y in itertools.combinations(rows, 2):
        if x["node"] == y["node"] and x["label"] != y["label"] and not met_earlier(x, y):
            if 2 * (np.frombuffer(x["tokens"], "<u2") == np.frombuffer(y["tokens"], "<u2")).sum() >= near_dedup.COORDINATES:
                yield x, y


def groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent) if root(x) != x}


def several_nodes():
    rng = random.Random(3)
    rows = []
    for node, (n, tree) in enumerate([(2, 3), (1, 0), (40, None), (5, 2), (70, 6), (33, 0), (3, None), (20, 9), (60, None)]):
        labels = [rng.choice([5, 5, 5, *range(100 * node, 100 * node + n)]) for _ in range(n)]
        rows += node_rows(node, texts_of(node, n), labels, tree)
    return rows


def work_of(monkeypatch, step):
    """What ``step`` does to the rows of nodes."""
    monkeypatch.setattr(near_dedup, "in_nodes", lambda rows, work, schema: work)

    class Members:
        def select(self, *columns):
            return self

    return step(Members())


def test_a_node_of_many_alike_texts_is_not_compared_pair_by_pair(monkeypatch):
    """pairs under 75 % that share most tokens made one intersection each, half the square of the node."""
    compared = []
    similar = near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda a, b: compared.append(1) or similar(a, b))
    rows = node_rows(1, texts_of(11, 150, 120, 10), list(range(150)), None)
    pairs = list(plain_pairs(rows))
    want = groups((x["label"], y["label"]) for x, y in pairs if alike(x, y))
    found = [r for b in work_of(monkeypatch, near_dedup.linked)(batch_of(rows)) for r in b.to_pylist()]
    assert groups((r["a"], r["b"]) for r in found) == want and want
    assert sum(not alike(x, y) for x, y in pairs) > 1_000
    assert len(compared) <= 3 * len(rows)


@pytest.mark.parametrize("listed", [1, 16_384])
def test_pairs_of_several_nodes(monkeypatch, listed):
    monkeypatch.setattr(near_dedup, "PAIRS", listed)
    rows = several_nodes()
    pairs = [(x["rep"], y["rep"]) for x, y in plain_pairs(rows)]
    a, b = near_dedup.Nodes(batch_of(rows)).close_pairs()
    got = sorted(tuple(sorted((rows[i]["rep"], rows[j]["rep"]))) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert got == sorted(pairs)
    found = [r for x in work_of(monkeypatch, near_dedup.promising)(batch_of(rows)) for r in x.to_pylist()]
    assert sorted(r["rep"] for r in found) == sorted({rep for pair in pairs for rep in pair})
    want = groups((x["label"], y["label"]) for x, y in plain_pairs(rows) if alike(x, y))
    found = [r for x in work_of(monkeypatch, near_dedup.linked)(batch_of(rows)) for r in x.to_pylist()]
    assert groups((r["a"], r["b"]) for r in found) == want


@pytest.mark.parametrize("rows", [1, 7, 50, 1_000])
def test_nodes_stay_whole_in_any_batches(rows):
    every = batch_of(several_nodes())
    got = list(near_dedup.by_node(every.slice(i, rows) for i in range(0, every.num_rows + 1, rows)))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([every]))
    nodes = [set(x.column("node").to_pylist()) for x in got]
    assert sum(map(len, nodes)) == len(set().union(*nodes))


@pytest.mark.parametrize(("values", "matrix"), [(1_000_000, 16_000_000), (60, 1)])
@pytest.mark.parametrize("n", [4, 40, 150])
def test_every_link_of_many_sets(monkeypatch, values, matrix, n):
    monkeypatch.setattr(near_dedup, "VALUES", values)
    monkeypatch.setattr(near_dedup, "MATRIX", matrix)
    sets = [np.array(plain_shingles(t), np.uint64) for t in [*texts_of(n, n - 3, 60, 6), *texts_of(n + 1, 2), "a b"]]
    sets[1] = sets[0][:3 * len(sets[0]) // 4 + (n == 40)]
    a, b = np.array(list(itertools.permutations(range(n), 2))).T
    want = [4 * len(x & y) >= 3 * len(x | y) for x, y in itertools.permutations([set(s.tolist()) for s in sets], 2)]
    assert near_dedup.all_links(sets, a, b).tolist() == want
    assert [near_dedup.similar(sets[i], sets[j]) for i, j in zip(a, b, strict=True)] == want


def test_smallest_reached():
    edges = [(5, 3), (9, 9), (3, 1), (100, 101), (8, 7), (6, 7), (8, 101)]
    a, b = near_dedup.smallest(*np.array(edges).T)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == groups(edges)
    assert [len(x) for x in near_dedup.smallest(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


@pytest.mark.parametrize("size", [10, 200, 4_000_000])
def test_shingles_of_a_batch(monkeypatch, size):
    monkeypatch.setattr(near_dedup, "SLICE", size)
    texts = [*ODD, *texts_of(2, 10, 30), *ODD[::-1]]
    got = list(near_dedup.shingle_sets(pa.array(["cut off", *texts]).slice(1)))
    assert [s.tolist() for s in got] == [plain_shingles(t) for t in texts]
    assert list(near_dedup.shingle_sets(pa.array([], pa.string()))) == [] and [len(s) for s in near_dedup.shingle_sets(pa.array([" ", ""]))] == [0, 0]
    products = np.empty((near_dedup.COORDINATES, near_dedup.BLOCK), np.uint64)
    for values in (got[0], got[15], np.arange(1, 2_000, dtype=np.uint64)):
        want = [min([v * int(m) % 2**64 for v in values.tolist()], default=2**64 - 1) for m in near_dedup.MULTIPLIERS]
        assert near_dedup.minwise(values, products).tolist() == want
