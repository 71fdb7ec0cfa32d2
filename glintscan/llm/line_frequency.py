"""Quality rules: lines that many documents of a host share are removed, and documents that lose too much are rejected.

Lines are compared after lower-casing, with digits as zeros and white space as single spaces, by a 64-bit hash. For each
host and line, the distinct documents (``doc_id``) that hold it are counted, exact copies of a text too. Over the limit, the
line is removed from every text. With ``spare_first`` the first text (smallest ``doc_id``) and its exact copies keep it, so that
a passage never disappears from a host altogether. Counting goes by (line, text) first, then by line, so no line is hot;
the look-up of removed lines is a sort-merge join of two written tables, which Spark splits where a line is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20
MIN_LEFT = 0.3
SPACES = " \t\n\v\f\r"
DIGITS = bytes.maketrans(b"123456789", b"000000000")
SLICE = 4_000_000


def text_key() -> Column:
    """128 bits of host and text, each behind its length, which is -1 for null."""
    part = lambda c: (F.coalesce(F.char_length(c), F.lit(-1)).cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.unhex(F.md5(F.concat_ws(":", *part("source"), *part("text"))))


def normal_line(line: bytes) -> bytes:
    """A lower-cased line with zeros as digits and single spaces."""
    return b" ".join(line.translate(DIGITS).split())


def word_numbers(data: bytes) -> np.ndarray:
    """The words of a text as numbers, equal for equal words; taken in slices, so a huge text needs no huge list."""
    index, parts, start = {}, [], 0
    while start < len(data):
        end = start + SLICE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        parts.append(np.array([index.setdefault(w, len(index)) for w in data[start:end].split()], np.int64))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    pairs = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * (int(words.max()) + 1) + words[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= again
    return int(covered.sum())


def text_facts(text: str) -> tuple[int, int, int, int, int, list[dict]]:
    """Words, their characters, symbols, repeated lines, repeated words, and the distinct lines with hash and words."""
    import xxhash

    words = word_numbers(text.encode())
    duplicates, seen, lines = 0, set(), {}
    for line in text.split("\n"):
        data = line.encode()
        n = len(data.split())
        if not n:
            continue
        duplicates += data in seen
        seen.add(data)
        key = xxhash.xxh3_64_intdigest(normal_line(line.lower().encode()))
        lines[key] = lines.get(key, 0) + n
    chars = len(text) - sum(text.count(c) for c in SPACES)
    listed = [{"line": k - 2**63, "words": n} for k, n in lines.items()]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicates, repeated_words(words), listed


def measure(docs: DataFrame) -> DataFrame:
    """Facts of every row: ``doc_id``, ``source``, ``text_key`` (hash of host and text), counts, ``lines``, ``base_failed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [text_facts(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*facts, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "source", "text_key")), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "source", "text_key", *NAMES, "lines"])

    kinds = docs.schema
    rows = docs.select("doc_id", "source", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = (f"doc_id {kinds['doc_id'].dataType.simpleString()}, source {kinds['source'].dataType.simpleString()}, text_key binary, "
              + ", ".join(f"{n} long" for n in NAMES) + ", lines array<struct<line: long, words: long>>")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def removed_lines(measured: DataFrame, max_docs: int = MAX_DOCS, spare_first: bool = False) -> DataFrame:
    """``text_key``, ``removed`` (hashes of its lines that go) and ``removed_words``, for the texts that lose lines."""
    held = staged(
        measured.select("doc_id", "text_key", "source", F.explode("lines").alias("l"))
        .groupBy(F.xxhash64("source", "l.line").alias("line_key"), "text_key", "doc_id")
        .agg(F.max("l.line").alias("line"), F.max("l.words").alias("words"))  # rows of one id and text are one document
        .groupBy("line_key", "text_key")
        .agg(F.min("doc_id").alias("doc_id"), F.max("line").alias("line"), F.max("words").alias("words"), F.count(F.lit(1)).alias("docs")))
    first = F.min(F.struct("doc_id", "text_key"))["text_key"] if spare_first else F.lit(None).cast("binary")
    common = staged(
        held.groupBy("line_key").agg(F.sum("docs").alias("docs"), first.alias("first_key")).filter(F.col("docs") > max_docs).select("line_key", "first_key"))
    return (
        held.join(common, "line_key").filter(~F.col("text_key").eqNullSafe(F.col("first_key"))).groupBy("text_key")
        .agg(F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words")))  # lines of one text


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, spare_first: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, the counts, ``base_failed``, ``removed``, ``removed_words``, ``kept``.

    ``docs`` has ``doc_id``, ``source`` (the host) and ``text``; other columns are ignored. A null text counts as empty, a
    null host is a host. ``removed`` are the hashes of the lines that go, null where none does. A document is rejected
    if it fails the base rules or keeps less than ``min_left`` of its words. Equal rows get equal verdicts.
    """
    measured = staged(measure(docs))
    removed = staged(removed_lines(measured, max_docs, spare_first))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return (
        measured.drop("lines").join(removed, "text_key", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * min_left))
        .select("doc_id", "text_key", *NAMES, "base_failed", "removed", "removed_words", "kept"))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, spare_first: bool = False) -> DataFrame:
    """The documents that ``judge`` keeps, all columns, without the lines that go; ``n_chars``, if there, follows."""
    verdicts = judge(docs, max_docs, min_left, spare_first).filter("kept").groupBy("text_key").agg(F.first("removed").alias("removed"))
    verdicts = staged(verdicts.withColumnRenamed("text_key", "verdict_key").withColumnRenamed("removed", "verdict_removed"))
    joined = docs.join(verdicts, text_key() == verdicts["verdict_key"]).select(*[docs[c] for c in docs.columns], verdicts["verdict_removed"])
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            columns = list(batch.columns)[:-1]
            texts = columns[at].to_pylist()
            for i, gone in enumerate(batch.columns[-1].to_pylist()):
                if gone:
                    gone = set(gone)
                    texts[i] = "\n".join(x for x in texts[i].split("\n") if not x.encode().split() or
                                         xxhash.xxh3_64_intdigest(normal_line(x.lower().encode())) - 2**63 not in gone)
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.record_batch(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
