"""Near-duplicate documents by the Chosen Path set similarity join.

A document is its set of word shingles. Equal sets are one text from the start. Each text gets minwise tokens, the smallest
hash of its shingles under each of ``COORDINATES`` hash functions; two texts share a token with a chance equal to their
similarity. Every tree starts at another token: texts that share it are a node. A node of at most ``SMALL`` texts is compared
exhaustively, on tokens first and then, where these leave a chance, on the full sets. A larger node is branched by
further tokens, which the node itself selects, and its children are treated alike. ``TREES`` independent trees find a link of
similarity 0.75 in small nodes but for a chance of 0.25 ** 16. Two texts that meet in small nodes of several trees are compared
in the first of these only, so that their sets travel once.

Only the components matter, so work stops where it cannot change them. First, three trees and, for large nodes, the links to a
few texts of the node give most links, and the components of these become labels. From then on only texts of different
labels are compared, in the other trees: a node of one label is done, and a node whose texts outside its commonest label are few is dealt out as
those few beside parts of the rest. What is still large at the last level is compared part by part. So a node
never comes to one task as a whole, nor does the comparison lose a link by a cap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .components import components

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
TREES = 16
FIRST_TREES = 3
SMALL = 800
CENTRES = 8
BRANCHES = 2
LEVELS = 5
#: Share of equal tokens under which full sets are not compared: 4.6 standard deviations below 0.75.
CHANCE = 0.5
MULTIPLIERS = np.random.default_rng(20_240_101).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = np.random.default_rng(7).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 4_000_000
#: Values that are multiplied at a time: with all multipliers they fit a core's cache.
BLOCK = 512
#: Members up to which the pairs of a node are listed with those of other nodes, and pairs compared at a time.
FEW = 32
PAIRS = 16_384
#: Shingles of members of a node, or pairs that share one, and bytes of a matrix of members and shingles at a time.
VALUES = 1_000_000
MATRIX = 16_000_000
#: Columns of a member of a node: ``small_in`` has a bit for each tree in which its node is small, ``roots`` 16 bits of each root
#: token, which make 32 with those of ``tokens``. Nodes of large nodes' members have no tree.
MEMBER = ["node", "rep", "label", "tokens", "tree", "roots", "small_in"]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a lower-cased text."""
    parts, start = [], 0
    while start < len(data):  # slices that end at white space, so a huge text needs no huge list
        end = start + SLICE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(hashes(data[start:end].split()))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def hashes(words: list[bytes] | np.ndarray) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` words in a row."""
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * POWERS[k] + words[k:n + k]
    out ^= out >> np.uint64(32)
    return out * POWERS[0]


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = word_hashes(text.encode().lower())  # of bytes, lower() changes A-Z only
    if not len(words):
        return words
    return distinct(mixed(words, min(len(words), SHINGLE)))


def distinct(values: np.ndarray) -> np.ndarray:
    """``values``, of which there are some, in their order and once each."""
    values = np.sort(values)
    first = np.empty(len(values), bool)
    first[0] = True
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """``shingles`` of each of ``texts`` (without nulls), those of up to ``SLICE`` bytes together in Arrow."""
    sizes = pc.binary_length(texts).to_numpy()
    start, n = 0, len(sizes)
    while start < n:
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:], dtype=np.int64), SLICE, "right")))
        if sizes[start] > SLICE:
            yield shingles(texts[start].as_py())
        else:
            yield from some_sets(texts.slice(start, end - start))
        start = end


def some_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten().cast(pa.binary()).dictionary_encode()
    full = pc.binary_length(words.dictionary).to_numpy() > 0  # white space at an end leaves an empty word
    values = hashes(words.dictionary.to_numpy(zero_copy_only=False))
    at = words.indices.to_numpy()
    counts = pc.list_value_length(parts).to_numpy()
    if not full.all():
        there = full[at]
        at, counts = at[there], np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
    values, ends = values[at], np.cumsum(counts)
    long = mixed(values, SHINGLE) if len(values) >= SHINGLE else None
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= SHINGLE:
            yield distinct(long[end - count:end - SHINGLE + 1])
        else:
            yield mixed(values[end - count:end], count) if count else values[:0]


def minwise(values: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The smallest product with each multiplier; ``products`` has room for those of ``BLOCK`` values."""
    least = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(values), BLOCK):
        some = values[at:at + BLOCK]
        least = np.minimum(least, np.multiply(some, MULTIPLIERS[:, None], out=products[:, :len(some)]).min(axis=1))
    return least


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` (128 bits of the set), ``roots`` and ``tokens`` of every row.

    The roots are the minwise tokens that trees start at, ``tokens`` the last 16 bits of all: enough to compare texts by,
    for unequal ones agree once in 65,536 times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        products = np.empty((COORDINATES, BLOCK), np.uint64)
        for batch in batches:
            sizes, keys, roots, tokens = [], [], [], []
            for values in shingle_sets(batch.column("text")):
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                least = minwise(values, products)
                roots.append(least[:TREES].astype(np.int64, casting="unsafe") if len(values) else None)
                tokens.append((least ^ (least >> np.uint64(31))).astype("<u2", casting="unsafe").tobytes() if len(values) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                ["doc_id", "n_shingles", "key", "roots", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, roots array<long>, tokens binary")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and ``shingles`` (sorted 64-bit hashes as bytes) of the texts in ``wanted`` (``rep``, ``key``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            fits = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("rep").filter(pa.array(fits)), pa.array(sets, pa.binary()).filter(pa.array(fits))], ["rep", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("text IS NOT NULL")
    return rows.join(wanted, "rep").dropDuplicates(["rep", "text"]).select("rep", "text", "key").mapInArrow(run, "rep long, shingles binary")


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole nodes, several nodes at a time, from batches sorted by node."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        last = int(np.searchsorted(nodes, nodes[-1]))  # where the last node starts, which may go on
        if rest and (last or rest[0].column("node")[0].as_py() != nodes[0]):
            yield whole([*rest, batch.slice(0, last)])
            rest = []
        elif last:
            yield batch.slice(0, last)
        rest.append(batch.slice(last))
    if rest:
        yield whole(rest)


def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_numpy(zero_copy_only=False)), "<u2").reshape(len(column), COORDINATES)


class Nodes:
    """Rows of whole nodes: tokens, labels, and what tells whether two members have met in an earlier tree."""

    def __init__(self, rows: pa.RecordBatch):
        self.tokens, self.labels = token_rows(rows.column("tokens")), rows.column("label").to_numpy()
        node = rows.column("node").to_numpy()
        self.bounds = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        self.tree = rows.column("tree").fill_null(0).to_numpy()  # none is earlier
        used = int(self.tree.max())
        self.roots, self.small = np.zeros((len(node), used), np.uint32), np.zeros((len(node), used), bool)
        if used:
            here = np.flatnonzero(rows.column("roots").is_valid().to_numpy(zero_copy_only=False))
            roots = rows.column("roots").flatten().to_numpy().view(np.uint16).reshape(-1, TREES)[:, :used]
            self.roots[here] = roots.astype(np.uint32) << np.uint32(16) | self.tokens[here, :used]
            self.small = (rows.column("small_in").to_numpy()[:, None] >> np.arange(used) & 1) == 1

    def close_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different labels in a node that share enough tokens and meet here first."""
        found = [*self.in_few()]
        for low, high in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if high - low > FEW:
                found += self.in_many(low, high)
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))

    def in_few(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the nodes of at most ``FEW`` members, listed."""
        sizes = np.diff(self.bounds)
        later = np.repeat(self.bounds[1:], sizes) - np.arange(self.bounds[-1]) - 1  # members of its node after each row
        later[np.repeat(sizes > FEW, sizes)] = 0
        ends = np.cumsum(later)
        start = 0
        while start < len(later):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = later[start:end]
            a = np.repeat(np.arange(start, end), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            other = self.labels[a] != self.labels[b]
            a, b = a[other], b[other]
            shared = np.bitwise_count(np.packbits(self.tokens[a] == self.tokens[b], axis=1).view(np.uint64).reshape(-1))
            near = shared >= CHANCE * COORDINATES
            a, b = a[near], b[near]
            met = (self.roots[a] == self.roots[b]) & self.small[a] & (np.arange(self.roots.shape[1]) < self.tree[a, None])
            first = ~met.any(axis=1)
            yield a[first], b[first]
            start = end

    def in_many(self, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of one node, each member beside those after it; the commonest label comes last, as it has none."""
        _, label, count = np.unique(self.labels[low:high], return_inverse=True, return_counts=True)
        order = np.lexsort((label, count[label])) + low
        tree, label = int(self.tree[low]), label[order - low]
        tokens, roots, small = (np.ascontiguousarray(x.T) for x in (self.tokens[order], self.roots[order, :tree], self.small[order, :tree]))
        for i in range(len(order) - int(count.max())):
            shared = (tokens[:, i + 1:] == tokens[:, i:i + 1]).view(np.uint8).sum(axis=0, dtype=np.uint8)
            first = (shared >= CHANCE * COORDINATES) & (label[i + 1:] != label[i])
            if tree and first.any():
                first &= ~((roots[:, i + 1:] == roots[:, i:i + 1]) & small[:, i:i + 1]).any(axis=0)
            if len(near := np.flatnonzero(first)):
                yield np.full(len(near), order[i]), order[near + i + 1]


def in_nodes(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` applied to the rows of nodes; nodes are small, so a partition takes them a batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in by_node(batches):
            yield from work(nodes)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def promising(members: DataFrame) -> DataFrame:
    """``node``, ``rep`` and ``tree`` of the members that share enough tokens with one of another label."""
    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = Nodes(rows).close_pairs()
        if len(a):
            there = np.zeros(rows.num_rows, bool)
            there[a] = there[b] = True
            take = pa.array(np.flatnonzero(there))
            yield pa.record_batch([rows.column(c).take(take) for c in ("node", "rep", "tree")], ["node", "rep", "tree"])

    return in_nodes(members.select(*MEMBER), work, "node long, rep long, tree int")


def linked(members: DataFrame) -> DataFrame:
    """Pairs of labels that links between their texts join, confirmed on the full sets: each label and the smallest one it reaches in nodes."""
    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = Nodes(rows)
        a, b = nodes.close_pairs()
        if not len(a):
            return
        at = np.searchsorted(nodes.bounds, a, "right")
        order = np.argsort(at, kind="stable")
        a, b, cuts = a[order], b[order], np.flatnonzero(np.diff(at[order])) + 1
        column, found = rows.column("shingles"), []
        for x, y in zip(np.split(a, cuts), np.split(b, cuts), strict=True):
            used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            sets = [np.frombuffer(s, "<u8") for s in column.take(pa.array(used)).to_numpy(zero_copy_only=False)]
            good = links(sets, place[:len(x)], place[len(x):], nodes.labels[used])
            found.append((nodes.labels[x[good]], nodes.labels[y[good]]))
        x, y = smallest(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
        if len(x):
            yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])

    return in_nodes(members.select(*MEMBER, "shingles"), work, "a long, b long")


def links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a``, ``b`` of ``sets`` are links; of a few pairs those that join labels, whose links join as many as all do."""
    if len(a) > 3 * len(sets):
        return all_links(sets, a, b)
    good = np.zeros(len(a), bool)
    parent = {int(x): int(x) for x in labels.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(int(labels[i])), root(int(labels[j]))
        if x != y and similar(sets[i], sets[j]):
            parent[max(x, y)] = min(x, y)
            good[k] = True
    return good


def all_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a``, ``b`` of ``sets`` are links, by the exact size of every intersection.

    The sets are taken in ranges of hashes, so that no copy of a node as a whole is needed.
    """
    sizes = np.array([len(s) for s in sets])
    ranges = -(-int(sizes.sum()) // VALUES)
    cuts = [np.searchsorted(s, np.linspace(0, 2.0**64, ranges + 1)[1:-1].astype(np.uint64)).tolist() for s in sets]
    common = np.zeros((len(sets), len(sets)), np.int32)
    for low, high in zip([[0] * len(sets), *zip(*cuts, strict=True)], [*zip(*cuts, strict=True), sizes.tolist()], strict=True):
        count_common([s[x:y] for s, x, y in zip(sets, low, high, strict=True)], common)
    both = common[np.minimum(a, b), np.maximum(a, b)].astype(np.int64)
    return 100 * both >= PERCENT * (sizes[a] + sizes[b] - both)


def count_common(sets: list[np.ndarray], common: np.ndarray) -> None:
    """Adds to ``common`` how many values each set shares with each later one.

    Values of many sets are bits of a matrix, whose rows are intersected word by word; of the others, the pairs of sets
    that hold one are counted.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    bounds = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    holders, starts = np.diff(bounds), bounds[:-1]
    few = max(1, n // 16)
    many = np.flatnonzero(holders > few)
    step = max(64, MATRIX // n // 64 * 64)
    for low in range(0, len(many), step):
        part = many[low:low + step]
        held = holders[part]
        at = np.repeat(starts[part] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        bits = np.zeros((n, -(-len(part) // 64) * 64), bool)
        bits[owner[at], np.repeat(np.arange(len(part)), held)] = True
        words = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)
        for i in range(n - 1):
            common[i, i + 1:] += np.bitwise_count(words[:, i + 1:] & words[:, i:i + 1]).sum(axis=0, dtype=np.int32)
    pairs: list[np.ndarray] = []
    for held in np.unique(holders[(holders > 1) & (holders <= few)]).tolist():
        x, y = np.triu_indices(held, 1)  # the owners of a value are in their order
        own, step = starts[holders == held], max(1, VALUES // len(x))
        for low in range(0, len(own), step):
            each = owner[own[low:low + step, None] + np.arange(held)]
            pairs.append((each[:, x] * n + each[:, y]).ravel())
            if sum(map(len, pairs)) >= VALUES:
                common += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
                pairs = []
    if pairs:
        common += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the linked numbers ``a``, ``b`` that reaches a smaller one, and the smallest it reaches."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    root = np.arange(len(names))
    while len(x):
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def described(nodes: DataFrame) -> DataFrame:
    """``node``, ``n`` and ``inside`` (members of its commonest label ``main``) of the nodes with several labels."""
    return (
        nodes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node")
        .agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        .select("node", "n", F.col("m.c").alias("inside"), F.col("m.label").alias("main")))


def sets_of(docs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    return staged(full_sets(docs, texts.select("rep", "key").join(wanted.select("rep").distinct(), "rep", "left_semi")))


def link(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) whose components are those of all links between ``texts`` (``rep``, ``key``, ``roots``, ``tokens``)."""
    roots = F.transform("roots", lambda t, i: F.struct(i.alias("tree"), F.xxhash64(i, t).alias("node")))
    grown = texts.select("rep", F.explode(roots).alias("r")).select("rep", "r.tree", "r.node")
    sizes = staged(grown.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    places = grown.join(sizes, "node").groupBy("rep").agg(F.collect_list(F.struct("tree", "node", "n")).alias("places"))  # one a tree at most
    bits = F.aggregate("places", F.lit(0), lambda bits, p: bits + F.when(p["n"] <= SMALL, F.call_function("shiftleft", F.lit(1), p["tree"])).otherwise(0))
    short = F.transform("roots", lambda t: (F.pmod(F.shiftright(t, 20), F.lit(2**16)) - 2**15).cast("short"))
    # tokens once a text; its nodes are rows only on the way to a shuffle
    placed = staged(places.join(texts.select("rep", "tokens", short.alias("roots")), "rep").select("rep", "tokens", "roots", bits.alias("small_in"), "places"))
    active = placed.select("rep", "tokens", "roots", "small_in", F.explode("places").alias("p")).select(
        "p.node", "rep", "tokens", "p.tree", "roots", "small_in", "p.n")
    small = active.filter(F.col("n") <= SMALL).withColumn("label", F.col("rep"))
    near, pairs = staged(promising(small)), staged(near_centres(active.filter(F.col("n") > SMALL)))
    early, late = near.filter(F.col("tree") < FIRST_TREES), near.filter(F.col("tree") >= FIRST_TREES)

    # First look: small nodes of three trees, and the centres of large nodes.
    sets = sets_of(docs, texts, early.select("rep").unionByName(pairs.select("rep")).unionByName(pairs.select(F.col("centre").alias("rep"))))
    first = small.filter(F.col("tree") < FIRST_TREES).join(early, ["node", "rep"], "left_semi").join(sets, "rep")
    labels = staged(components(linked(first).unionByName(star_links(pairs, sets))).select(F.col("v").alias("rep"), "component"))
    label = F.coalesce("component", "rep").alias("label")
    known = labels.select(F.col("rep").alias("a"), F.col("component").alias("b"))

    # Second look: small nodes of the other trees and what becomes of the large ones, as far as labels differ.
    members = late.join(labels, "rep", "left").select("node", "rep", "tree", label)
    members = members.join(staged(described(members)).select("node"), "node", "left_semi")
    members = staged(members.join(placed.drop("places"), "rep").select(*MEMBER))
    members = members.join(staged(promising(members)), ["node", "rep"], "left_semi")  # next to the labels, few are left
    dealt = branched(active.filter(F.col("n") > SMALL).select("node", "rep", "tokens").join(labels, "rep", "left").select("node", "rep", "tokens", label))
    if dealt is not None:
        dealt = dealt.select("*", F.lit(None).cast("int").alias("tree"), F.lit(None).cast("array<short>").alias("roots"), F.lit(0).alias("small_in"))
        far = staged(promising(dealt))
        members = members.select(*MEMBER).unionByName(dealt.join(far, ["node", "rep"], "left_semi").select(*MEMBER))
    members = staged(members)
    sets = sets.unionByName(sets_of(docs, texts, members.select("rep").join(sets, "rep", "left_anti")))
    return known.unionByName(staged(linked(members.join(sets, "rep"))))


def near_centres(large: DataFrame) -> DataFrame:
    """Distinct pairs (``rep``, ``centre``) of a member of a large node and the two of its centres that share most tokens with it.

    The centres are the members with the smallest hashes, so that nodes with the same members have the same ones.
    Centres that share too few tokens are left out; the second look misses nothing by that.
    """
    centre = lambda seed: F.min(F.struct(F.xxhash64(F.lit(seed), "rep").alias("h"), "rep", "tokens"))
    centres = large.groupBy("node").agg(F.array(*[centre(s) for s in range(CENTRES)]).alias("c"))
    centres = staged(centres.select("node", F.col("c.rep").alias("centres"), F.col("c.tokens").alias("centre_tokens")))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = batch.column("rep").to_numpy()
            ids = batch.column("centres").flatten().to_numpy().reshape(-1, CENTRES)
            tokens = token_rows(batch.column("centre_tokens").flatten()).reshape(-1, CENTRES, COORDINATES)
            shared = (tokens == token_rows(batch.column("tokens"))[:, None, :]).sum(axis=2)
            for k in range(CENTRES):  # a centre once, and nothing beside itself
                shared[(ids[:, k] == reps) | (ids[:, :k] == ids[:, k:k + 1]).any(axis=1), k] = -1
            best = np.argsort(-shared, axis=1, kind="stable")[:, :2]
            rows, columns = np.nonzero(np.take_along_axis(shared, best, 1) >= CHANCE * COORDINATES)
            yield pa.record_batch([pa.array(reps[rows]), pa.array(ids[rows, best[rows, columns]])], ["rep", "centre"])

    both = large.join(centres, "node").select("rep", "tokens", "centres", "centre_tokens")
    return both.mapInArrow(closest, "rep long, centre long").distinct()


def branched(members: DataFrame) -> DataFrame | None:
    """Small nodes in which all texts of different labels in the nodes of ``members`` meet with the chance of a tree; None without any."""
    out: DataFrame | None = None
    for level in range(LEVELS + 1):
        members = staged(members)
        facts = staged(described(members))
        if facts.isEmpty():
            break
        members = members.join(facts, "node")
        few = (F.col("n") <= SMALL) | (F.col("n") - F.col("inside") <= SMALL)
        part = dealt_out(members.filter(few))
        members = members.filter(~few)
        if level == LEVELS:
            part = part.unionByName(in_parts(members))
        out = part if out is None else out.unionByName(part)
        chosen = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda k: (TREES + F.pmod(F.xxhash64("node", k), F.lit(COORDINATES - TREES))).cast("int"))
        members = members.select("node", "rep", "tokens", "label", F.explode(chosen).alias("at")).select(
            F.xxhash64("node", "at", F.substring("tokens", F.col("at") * 2 + 1, F.lit(2))).alias("node"), "rep", "tokens", "label")
    return None if out is None else staged(out)


def star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a text and a centre that are links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(
                batch.column("shingles").to_pylist(), batch.column("centre_shingles").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("rep").filter(pa.array(good, pa.bool_())), batch.column("centre").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    both = pairs.join(sets, "rep").join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("centre_shingles")), "centre")
    return both.mapInArrow(run, "a long, b long")


def dealt_out(members: DataFrame) -> DataFrame:
    """Nodes as they are if small, else the members outside the commonest label beside each part of those inside."""
    parts = F.when(F.col("n") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("inside") / SMALL)).cast("int")
    mine = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
    return members.select("node", "rep", "tokens", "label", F.explode(mine).alias("part")).select(
        F.xxhash64("node", "part").alias("node"), "rep", "tokens", "label")


def in_parts(members: DataFrame) -> DataFrame:
    """Every pair of parts of a node as a node, so that all members meet without a task seeing more than two parts."""
    parts = F.ceil(F.col("n") * 2 / SMALL).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    return members.select("node", "rep", "tokens", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select(
        F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "tokens", "label")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``; other columns are ignored. Documents are linked if their sets of
    shingles are at least 75 % alike; the component's id is the smallest ``doc_id`` reachable. A null text, or one
    without words, is linked with nothing. A row with a null id is linked with nothing, has the component null and
    is kept. A text of any length is taken whole, in slices. Rows that share an id count as one document with several texts. Equal rows get equal results.
    """
    rows = staged(sketch(docs))
    texts = staged(
        rows.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "roots", "tokens")).alias("m"))
        .select("key", F.col("m.doc_id").alias("rep"), "m.roots", "m.tokens"))
    members = staged(rows.select("doc_id", "n_shingles", "key").join(texts.select("key", "rep"), "key", "left"))
    again = members.filter("doc_id IS NOT NULL AND rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = again.join(texts.select(F.col("rep").alias("a")), "a", "left_semi")  # ids with several texts
    found = staged(components(link(docs, texts).unionByName(repeated)))
    out = members.join(found.withColumnRenamed("v", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that ``deduplicate`` keeps, all columns; of rows that share an id, one (by a hash of the text)."""
    kept = staged(deduplicate(docs).filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("rows")))
    once = docs.join(kept.filter("rows = 1"), F.col("doc_id") == F.col("kept_id"), "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    several = kept.filter("rows > 1")
    if several.isEmpty():
        return once
    row = F.struct(*[docs[c] for c in docs.columns])
    chosen = docs.join(several, F.col("doc_id") == F.col("kept_id"), "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64("text")).alias("row"))
    return once.unionByName(chosen.select("row.*"))
