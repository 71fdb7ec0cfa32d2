"""Jaccard join of word n-grams in size-banded tiles.

A document is its set of word 4-grams, a link a pair with at least 85 % in common. The method is exact.

* **Bands.** Sets are banded by size. Two sets of a link differ in size by a known ratio, so a set belongs to its own band and, if it is
  near the lower border, as a guest to the band below: every link lies within some band.
* **Tiles.** The largest sets of a band fix ``D``, the most elements in which two linked sets of it can differ. Hashes of the elements
  cut every set into parts, more than ``D`` of them, so two linked sets have an equal part. A tile holds the sets of a band that are
  equal in one part; a part is some five elements, so texts that merely share a passage do not meet. Equal *empty* parts say nothing,
  so there are ``spare`` more parts than that, and only a set with more empty parts than ``spare`` uses its empty ones.
* **Bitmaps.** Every set has a bitmap of parities. Counting the bits in which two bitmaps differ bounds the overlap from above:
  ``(a + b - bits) / 2``. In a tile, sets are compared by a shorter one, long enough to tell unlike sets apart at any size; a pair that is left, once
  by a bitmap as long as its sets; only pairs whose bound still reaches the threshold go on to the intersection of the sorted arrays. Tiles with the same members are one.
* **Labels.** Components are all that matters, so first each member of a tile is tried against the tile's smallest id, then against the one
  whose bitmap is closest; what these link gets one label. Last, all pairs of different labels in a tile are compared, large tiles in blocks
  of a fixed size, so a group of copies is one label by then, and no tile comes to one task as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged
from .components import components
from .shingle_sets import Shingler, bitmap, mixed

WIDTH = 4
PERCENT = 85
#: Upper border of a band over its lower one.
RATIO = Fraction(3, 2)
LARGEST_SET = 2**31
#: Most members of a block; bits of a bitmap in a tile: so many or, where that is more, three for each element in which sets of a link can
#: differ (sets that differ in all of them fill half of the bits, beyond what a link may), up to a bound.
BLOCK = 700
FEW_BITS = 1024
FEW_PER_DIFFERENCE = 3
MOST_BITS = 2**17


class Band(NamedTuple):
    low: int  # smallest and largest size of its own sets
    high: int
    guests: int  # largest size of a guest
    parts: int
    spare: int
    bits: int
    few: int


def tail(mean: float, most: int) -> float:
    """The chance that a Poisson variable exceeds ``most``."""
    return max(0.0, 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(most + 1)))


def bands(percent: int) -> list[Band]:
    """The bands for sets that have ``percent`` of their union in common."""
    out, low = [], 1
    while low < LARGEST_SET:
        high = max(low, math.ceil(low * RATIO) - 1)
        guests = high * 100 // percent
        differ = (100 - percent) * (high + guests) // (100 + percent)
        spare = 0
        if differ:  # spare parts until a set seldom has more empty ones; more of them make smaller parts
            chance = lambda z: tail((differ + 1 + z) * math.exp(-low / (differ + 1 + z)), z)
            spare = next((z for z in range(13) if chance(z) < 1e-7), min(range(5), key=chance))
        bits = 64 * math.ceil(2 * high / 64)
        few = min(bits, MOST_BITS, max(FEW_BITS, 64 * math.ceil(FEW_PER_DIFFERENCE * differ / 64)))
        out.append(Band(low, high, guests, differ + 1 + spare, spare, bits, few))
        low = high + 1
    return out


def similar_enough(differ: np.ndarray | int, sizes: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """The threshold for two sets that differ in so many elements and have so many together."""
    return (100 + percent) * differ <= (100 - percent) * sizes


def part_hashes(values: np.ndarray, parts: int, spare: int, number: int) -> np.ndarray:
    """A hash of every part of a sorted set that takes part in tiles; its last 8 bits are the number of the band."""
    edges = (np.arange(parts + 1, dtype=np.float64) / parts * 2.0**32).astype(np.uint64)
    edges[1:-1] <<= np.uint64(32)
    cuts = np.searchsorted(values, edges[1:-1])
    cuts = np.concatenate([[0], cuts, [len(values)]]).astype(np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values), dtype=np.uint64)])
    hashes = mixed((sums[cuts[1:]] - sums[cuts[:-1]]) ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(number << 32)))
    empty = cuts[1:] == cuts[:-1]
    if empty.sum() <= spare:
        hashes = hashes[~empty]
    return (hashes & np.uint64(2**64 - 256) | np.uint64(number)).view(np.int64)


def sketch(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` (128 bits of the set), and ``places``: number, bitmaps and tiles of its bands."""
    table = bands(percent)
    lows = np.array([b.low for b in table])

    def places(values: np.ndarray) -> list[dict]:
        n = len(values)
        own = int(np.searchsorted(lows, n, "right")) - 1
        first = int(np.searchsorted(lows, -(-n * percent // 100), "right")) - 1
        return [
            {"band": b, "bits": bitmap(values, table[b].bits).tobytes(), "few": bitmap(values, table[b].few).tobytes(), "tiles": part_hashes(values, table[b].parts, table[b].spare, b)}
            for b in range(first, own + 1) if b == own or n <= table[b].guests]

    kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary()), ("few", pa.binary()), ("tiles", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(width)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = [shingler.shingles(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([places(s) if len(s) else None for s in sets], kind)], ["doc_id", "n_shingles", "key", "places"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, places array<struct<band:int,bits:binary,few:binary,tiles:array<long>>>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``doc`` and ``shingles`` (sorted 64-bit hashes as bytes) of the documents whose ids are in ``wanted`` (``doc``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.record_batch(
                    [part.column("doc"), pa.array([shingler.shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["doc", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("text IS NOT NULL")
    return rows.join(wanted.select("doc").distinct(), "doc", "left_semi").mapInArrow(run, "doc long, shingles binary").filter("length(shingles) > 0").distinct()


def bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def bounded(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (``a``, ``b``) of ``pairs`` (``band``, ``a``, ``b``) whose full bitmaps leave enough overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, sizes in zip(batch.column("a_bits").to_pylist(), batch.column("b_bits").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                differ = int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum())
                good.append(similar_enough(differ, sizes, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda s: marks.select("band", F.col("doc").alias(s), F.col("bits").alias(f"{s}_bits"), F.col("n").alias(f"{s}_n"))
    both = pairs.join(side("a"), ["band", "a"]).join(side("b"), ["band", "b"])
    near = both.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    return near.select("a", "b", "a_bits", "b_bits", (F.col("a_n") + F.col("b_n")).alias("sizes")).mapInArrow(run, "a long, b long").distinct()


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are links, by the exact intersection of their sorted sets, and its size ``common``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, good = [], []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                good.append(bool(similar_enough(len(x) + len(y) - 2 * common[-1], len(x) + len(y), percent)))
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"])
            yield out.filter(pa.array(good, pa.bool_()))

    pairs = staged(pairs)
    sets = staged(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")), width))
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long")


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one unit after another, from batches sorted by unit and band."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit, band = batch.column("unit").to_numpy(), batch.column("band").to_numpy()
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]) | (band[1:] != band[:-1])) + 1).tolist(), len(unit)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and (held[0].column("unit")[0].as_py(), held[0].column("band")[0].as_py()) != (unit[low], band[low]):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidates(members: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Distinct pairs (``band``, ``a``, ``b``) of a unit with different labels that the bound leaves; with ``closest``, of each member the closest only."""
    def work(unit: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, label, n = (unit.column(c).to_numpy() for c in ("doc", "label", "n"))
        bits = bitmaps(unit.column("few"))
        first, second = [], []
        best, partner = np.full(len(doc), np.inf), np.full(len(doc), -1)
        for i in range(len(doc) - 1):
            rest = np.flatnonzero((label[i + 1:] != label[i]) & (np.minimum(n[i + 1:], n[i]) * 100 >= np.maximum(n[i + 1:], n[i]) * percent)) + i + 1
            if not len(rest):
                continue
            differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1)
            good = similar_enough(differ.astype(np.int64), n[rest] + n[i], percent)
            rest, share = rest[good], differ[good] / (n[rest[good]] + n[i])
            if not len(rest):
                continue
            if closest:
                better = share < best[rest]
                best[rest[better]], partner[rest[better]] = share[better], i
                k = int(share.argmin())
                if share[k] < best[i]:
                    best[i], partner[i] = share[k], rest[k]
            else:
                first.append(np.full(len(rest), i))
                second.append(rest)
        if closest:
            first, second = [np.flatnonzero(partner >= 0)], [partner[partner >= 0]]
        if first and len(first[0]):
            x, y = doc[np.concatenate(first)], doc[np.concatenate(second)]
            yield pa.record_batch([unit.column("band").slice(0, 1).take(pa.array(np.zeros(len(x), int))), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["band", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            if unit.num_rows > 1:
                yield from work(unit)

    rows = members.select("unit", "band", "doc", "label", "n", "few").repartition("unit").sortWithinPartitions("unit", "band")
    return rows.mapInArrow(run, "band int, a long, b long").filter("a <> b").distinct()


def band_of(tile: str = "tile") -> Column:
    return F.col(tile).bitwiseAND(255).cast("int")


def blocked(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Units (``unit``, ``band``, ``doc``, ``label``) in which all members of a tile with different labels meet.

    A tile with few members is a unit. Of a larger one, the members outside its commonest label are dealt out to blocks, those inside
    to other blocks; a unit is two blocks, of which the first is outside.
    """
    rows = staged(tiles.join(labels, "doc", "left").select("tile", "doc", F.coalesce("label", "doc").alias("label")))
    facts = (
        rows.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("tile")
        .agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
        .filter("labels > 1").select("tile", "n", F.col("m.c").alias("inside"), F.col("m.label").alias("main")))
    rows = rows.join(staged(facts), "tile")
    out_blocks = F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
    in_blocks = F.ceil(F.col("inside") / BLOCK).cast("int")
    mine = lambda blocks: F.pmod(F.xxhash64("doc", "tile"), blocks).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = mine(out_blocks)
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), own), lambda i: pair(i, own)),
        F.transform(F.filter(F.sequence(F.lit(0), out_blocks + in_blocks - 1), lambda j: j > own), lambda j: pair(own, j)))
    inside = F.transform(F.sequence(F.lit(0), out_blocks - 1), lambda i: pair(i, out_blocks + mine(in_blocks)))
    where = F.when(F.col("n") <= BLOCK, F.array(pair(F.lit(0), F.lit(0)))).when(F.col("label") == F.col("main"), inside).otherwise(outside)
    return rows.select("tile", "doc", "label", F.explode(where).alias("w")).select(
        F.xxhash64("tile", "w.i", "w.j").alias("unit"), band_of().alias("band"), "doc", "label")


def label_of(links: DataFrame) -> DataFrame:
    return staged(components(links).select(F.col("v").alias("doc"), F.col("component").alias("label")))


class Sets(NamedTuple):
    """``members``: ``doc_id``, ``n_shingles`` and ``rep`` (smallest id with this set) of every row; ``marks``: ``band``, ``doc``, ``n``,
    ``bits`` and ``few`` of every rep; ``tiles``: ``tile`` and ``doc`` of the tiles with several reps, no two alike."""
    members: DataFrame
    marks: DataFrame
    tiles: DataFrame


def sets_and_tiles(docs: DataFrame, width: int, percent: int) -> Sets:
    rows = staged(sketch(docs, width, percent))
    reps = staged(rows.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")))
    members = rows.select("doc_id", "n_shingles", "key").join(reps, "key", "left").drop("key")
    mine = reps.select("key", F.col("rep").alias("doc_id"))
    placed = rows.join(mine, ["key", "doc_id"], "left_semi").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("places").alias("p"))
    placed = staged(placed.select("doc", "n", "p.*"))
    every = placed.select(F.explode("tiles").alias("tile"), "doc")
    several = every.groupBy("tile").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("tile")
    tiles = staged(every.join(several, "tile", "left_semi").distinct())
    alike = tiles.groupBy(band_of().alias("band"), "tile").agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.xxhash64(F.lit(k), "doc").cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)])
    alike = alike.filter("c > 1").groupBy("band", "c", "s0", "s1").agg(F.min("tile").alias("tile"))
    return Sets(staged(members), placed.select("band", "doc", "n", "bits", "few").distinct(), staged(tiles.join(staged(alike.select("tile")), "tile", "left_semi")))


def links(docs: DataFrame, sets: Sets, width: int, percent: int, every: bool = False) -> DataFrame:
    """Links (``a`` < ``b``, ``common``) between representatives: enough for the components, or with ``every`` all there are."""
    tiles, marks = sets.tiles, sets.marks
    if every:
        alone = tiles.select("doc").distinct().select("doc", F.col("doc").alias("label"))
        met = candidates(blocked(tiles, alone).join(marks, ["band", "doc"]), percent, closest=False)
        return confirmed(docs, bounded(met, marks, percent), width, percent)
    centres = tiles.groupBy("tile").agg(F.min("doc").alias("a"))
    stars = tiles.join(centres, "tile").filter("doc <> a").select(band_of().alias("band"), "a", F.col("doc").alias("b")).distinct()
    found = staged(confirmed(docs, bounded(stars, marks, percent), width, percent))
    for closest in (True, False):
        members = blocked(tiles, label_of(found)).join(marks, ["band", "doc"])
        met = bounded(candidates(members, percent, closest), marks, percent)
        found = found.unionByName(staged(confirmed(docs, met, width, percent)))
    return found


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    ``docs`` has ``doc_id`` (a whole number) and ``text``; other columns are ignored. ``n_shingles`` is the size of the set of n-grams
    of ``width`` words (A-Z lower-cased); a text of fewer words is one n-gram. Sets with ``percent`` of their union in common are linked;
    the component's id is the smallest ``doc_id`` reachable. A null text, or one without words, is linked with nothing. A row with a
    null id is linked with nothing and has the component null. Rows that share an id are one document with several texts. A text
    of any length is taken whole, at 8 bytes a word and some 30 a distinct n-gram. Equal rows get equal results.
    """
    sets = sets_and_tiles(docs, width, percent)
    known = sets.members.filter("doc_id IS NOT NULL AND rep IS NOT NULL")
    several = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a < last")  # ids with several texts
    again = known.join(several, "doc_id").select("a", F.col("rep").alias("b")).distinct()
    found = label_of(links(docs, sets, width, percent).select("a", "b").unionByName(again))
    out = sets.members.join(found, F.col("rep") == F.col("doc"), "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """All links between different sets: ``a`` < ``b`` (each the smallest id that holds its set) and ``common``, the n-grams in both.

    Together with the copies (``join`` puts them into one component) this is the whole join; its size is that of the result.
    """
    return links(docs, sets_and_tiles(docs, width, percent), width, percent, every=True)
