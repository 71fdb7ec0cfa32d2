"""Spelling variants: words that differ in one code point, and the frequent form that a rare one stands for.

Every word's edits are generated as hashes and probed against Bloom filters of the vocabulary. Deletions and replacements by a greater code
point are enough, since each pair of near words comes from exactly one of them. The hash of a word is a polynomial, so that of an edit follows from
the word's prefix sums without making the string, and a word of any length costs its edits only. The filters are sharded by the length
of the word and blocked (a word sets one bit in each of eight lanes of one block), and are broadcast: their size has a fixed bound,
beyond which they let more edits pass, no fewer. Edits that pass become strings and go to an exact join with the vocabulary, which
removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .shingle_sets import mixed

#: What a word is made of, after A-Z became lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_CHARS = 6
MIN_COUNT = 5
FACTOR = 5
SLICE = 4_000_000
#: Most different words that a task counts before it hands them on.
WORDS_HELD = 300_000
BITS_PER_WORD = 16
#: Upper bound of all filters together, 16 MB.
MAX_BITS = 2**27
LANES = 8
BLOCK_BITS = 32 * LANES
#: Words of this length and longer share a filter.
LONGEST = 64
#: Edits probed at a time, and words of a probing task.
PROBES = 1_000_000
WORDS_A_TASK = 10_000
BASE = np.random.default_rng(11).integers(1, 2**63, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SALTS = np.random.default_rng(13).integers(1, 2**31, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- words ------------------------------------------------------------------------
def runs(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, slice by slice."""
    text = text.encode().lower().decode()  # of bytes, lower() changes A-Z only
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        over = RUN.match(text, end)
        end = over.end() if over else end
        yield RUN.findall(text, start, end)
        start = end


def mistyped(word: str, doc_id: str, every: int) -> str:
    """The word, or where ``every`` divides the hash of document and word, the word without one of its code points."""
    h = zlib.crc32(word.encode(), zlib.crc32(f"{doc_id}:".encode()))
    return word if h % every else word[:h % len(word)] + word[h % len(word) + 1:]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``min_chars`` code points that occur at least ``min_count`` times in ``docs``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text has no words; a null id counts as an empty string.
    Every row counts, repeated ones too. ``typo_every`` plants typing errors: see ``mistyped``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words: Counter[str] = Counter()
                for part in runs(text):
                    words.update(part)
                for word, n in words.items():
                    if len(word) >= min_chars:
                        word = mistyped(word, doc_id, typo_every) if typo_every else word
                        if len(word) >= min_chars:
                            held[word] += n
                if len(held) > WORDS_HELD:
                    yield counted()
        yield counted()

    rows = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- hashes -----------------------------------------------------------------------
def same_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and code points (a row a word) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        step = max(1, PROBES // n)
        for low in range(0, len(at), step):
            some = at[low:low + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), "<u4").astype(np.uint64)
            yield some, codes.reshape(len(some), n)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Hashes of all beginnings of every word; the last column is that of the word."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(codes * powers(codes.shape[1]), axis=1, out=sums[:, 1:])
    return sums


class Layout(NamedTuple):
    """First block and number of blocks of the filter of every length up to ``LONGEST``."""
    first: np.ndarray
    blocks: np.ndarray


def layout(counts: dict[int, int]) -> Layout:
    share = min(BITS_PER_WORD, MAX_BITS / max(1, sum(counts.values())))
    blocks = np.array([max(1, int(counts[n] * share) // BLOCK_BITS) if counts.get(n) else 0 for n in range(LONGEST + 1)], np.uint64)
    return Layout(np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(np.int64), blocks)


def places(hashes: np.ndarray, length: int, plan: Layout) -> tuple[np.ndarray, np.ndarray]:
    """The block of every hash of words of a length, and the number that gives its bits."""
    h = mixed(hashes + np.uint64(length))
    shard = min(length, LONGEST)
    return plan.first[shard] + ((h >> np.uint64(32)) * plan.blocks[shard] >> np.uint64(32)).astype(np.int64), h & np.uint64(2**32 - 1)


def lane_bit(number: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << ((number * SALTS[lane] & np.uint64(2**32 - 1)) >> np.uint64(27)).astype(np.uint32)


def bloom_filter(words: DataFrame, plan: Layout) -> np.ndarray:
    """The lanes of all blocks (a row a block); no more than ``MAX_BITS`` and one block a length come to the driver."""
    names = [f"l{k}" for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in same_length(batch.column("word").to_pylist()):
                block, number = places(prefix_sums(codes)[:, -1], codes.shape[1], plan)
                yield pa.record_batch([pa.array(block), *[pa.array(lane_bit(number, k).view(np.int32)) for k in range(LANES)]], ["block", *names])

    bits = words.select("word").mapInArrow(run, "block long, " + ", ".join(f"{n} int" for n in names))
    rows = bits.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names]).toArrow()
    lanes = np.zeros((int(plan.blocks.sum()), LANES), np.uint32)
    for k, n in enumerate(names):
        lanes[rows["block"].to_numpy(), k] = rows[n].to_numpy().astype(np.int32).view(np.uint32)
    return lanes


def passing(hashes: np.ndarray, length: int, plan: Layout, lanes: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be words of this length."""
    if length < 1 or not plan.blocks[min(length, LONGEST)]:
        return np.zeros(0, np.int64)
    block, number = places(hashes, length, plan)
    left = np.arange(len(hashes))
    for k in range(LANES):
        left = left[(lanes[block[left], k] & lane_bit(number[left], k)) != 0]
    return left


def edits(codes: np.ndarray, alphabet: np.ndarray, plan: Layout, lanes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(row, place, code)`` of the edits that pass: the code point at the place goes (code 0) or becomes a greater one."""
    m, n = codes.shape
    sums, power = prefix_sums(codes), powers(n)
    whole = sums[:, -1:]
    step = max(1, PROBES // m)
    for low in range(0, n, step):
        part = codes[:, low:low + step]
        gone = sums[:, low:low + part.shape[1]] + (whole - sums[:, low + 1:low + 1 + part.shape[1]]) * INVERSE
        first = np.ones(part.shape, bool)  # of equal neighbours, one goes
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        if low:
            first[:, 0] = part[:, 0] != codes[:, low - 1]
        row, at = np.nonzero(first)
        for k in passing(gone[row, at], n - 1, plan, lanes).tolist():
            yield int(row[k]), int(at[k]) + low, 0
        for code in alphabet.tolist():
            row, at = np.nonzero(part < code)
            changed = whole[row, 0] + (np.uint64(code) - part[row, at]) * power[low + at]
            for k in passing(changed, n, plan, lanes).tolist():
                yield int(row[k]), int(at[k]) + low, code


# --- near words -------------------------------------------------------------------
def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (``word``, ``n``, ``near``, ``near_n``) of ``words`` (``word``, ``n``; distinct) that differ in one code point, each pair once."""
    spark = words.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONGEST))
    counts = {r[0]: r[1] for r in words.groupBy(length).agg(F.count(F.lit(1))).collect()}  # one row a length, at most LONGEST
    plan = layout(counts)
    # at most the code points that RUN admits
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()), np.uint64)
    sent = spark.sparkContext.broadcast(bloom_filter(words, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for at, codes in same_length(words):
                found = []
                for row, place, code in edits(codes, alphabet, plan, sent.value):
                    word = words[at[row]]
                    found.append((word, counts[at[row]], word[:place] + (chr(code) if code else "") + word[place + 1:]))
                if found:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["word", "n", "near"])

    tasks = max(1, -(-sum(counts.values()) // WORDS_A_TASK))
    positives = words.repartition(tasks).mapInArrow(run, "word string, n long, near string")
    return positives.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the chain of ``forms`` (``word``, ``form``) ends that starts at the word.

    Every round doubles the steps taken, and counts grow by ``FACTOR`` a step, so there are few rounds.
    """
    steps = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = staged(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if joined.filter("moved").isEmpty():
            return steps
        steps = joined.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row per row of ``words`` (``word``, ``n``; words are distinct): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Near words differ in exactly one inserted, deleted or replaced code point; ``n_near`` counts them. ``form`` is the near word of
    largest ``n`` (of equals the first in code-point order) if that is at least ``factor`` times the word's, else null, and ``form_n`` its
    count. ``root`` is the last form of the chain that starts at the word, the word itself if it has no form. No words give no rows.
    """
    words = staged(words.select("word", "n"))
    pairs = staged(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    fits = -F.col("best.order") >= factor * F.col("n")
    rows = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n")))
    roots = last_forms(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
