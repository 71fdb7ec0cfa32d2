"""Token ids in files of Simple-8b words.

A word has 64 bits: a selector in the top 4 and values in the other 60, the first value lowest. Selector ``s`` from
1 to 14 holds ``COUNTS[s]`` values of ``60 // COUNTS[s]`` bits; values missing at the end of a block are zeros. Selector
0 holds nothing but says that the next word is one whole value of 64 bits: the escape for values over 60 bits.

A file is a sequence of blocks of at most ``BLOCK`` ids, each of little-endian 64-bit words: ``MAGIC``; ids before the
block in this file; number of documents, of ids and of packed words; then two words for each document (its id, and the
number of its ids in this block times 4, plus 2 if the id is null, plus 1 if it goes on in the next block); then the packed
words. A reader finds every block by its lengths, and decodes it without looking at another one, all words of a
selector at once. Spark's text writer writes the files, with ``TRAILER`` as its line end, which closes each block; so a
file appears only when its task has committed, on every file system that Spark writes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_folder, staged
from .token_counts import unit_memory

#: How many values each selector packs.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK = 65_536
#: Documents that are encoded at a time, many, as most of their words are equal.
GROUP = 600
MAGIC = int.from_bytes(b"S8B-IDS1", "little")
TRAILER = "S8BBLOCK"
#: The bits of small values.
BITS = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Simple-8b words: each word takes as many values as fit."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    if values.max() < len(BITS):
        bits = BITS[values.astype(np.intp)]
    else:
        bits = np.searchsorted(np.uint64(1) << np.arange(61, dtype=np.uint64), values, side="right").astype(np.uint8)
    selector = np.zeros(n, np.uint8)
    widest = bits = np.concatenate([bits, np.zeros(COUNTS[1], np.uint8)])
    for count in range(1, COUNTS[1] + 1):  # the largest count that fits is set last
        if count > 1:
            widest = np.maximum(widest[:-1], bits[count - 1:])
        if count in COUNTS:
            fits = widest[:n] <= 60 // count
            if not fits.any():  # nor does any larger one
                break
            selector[fits] = COUNTS.index(count)
    # where the next word starts, for every place; the places themselves are found 16 words at a time
    after = np.append(np.minimum(np.arange(n) + np.maximum(np.array(COUNTS)[selector], 1), n), n)
    far = after
    for _ in range(4):
        far = far[far]
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = far.item(i)
    steps = [np.array(starts)]
    for _ in range(15):
        steps.append(after[steps[-1]])
    first = np.stack(steps, axis=1).ravel()
    first = first[first < n]
    chosen = selector[first]
    place = np.cumsum(1 + (chosen == 0)) - 1 - (chosen == 0)
    words = np.zeros(place[-1] + 1 + (chosen[-1] == 0), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in np.unique(chosen).tolist():
        rows = chosen == s
        if s == 0:
            words[place[rows] + 1] = values[first[rows]]
            continue
        word, at = np.full(rows.sum(), s << 60, np.uint64), first[rows]
        for k in range(COUNTS[s]):
            word |= padded[at + k] << np.uint64(k * (60 // COUNTS[s]))
        words[place[rows]] = word
    return words


def unpack(words: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` values of Simple-8b words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # the word after an escape is a value, whatever its top bits are
        kinds = []
        for s in selector.tolist():
            kinds.append(-1 if kinds and kinds[-1] == 0 else s)
        selector = np.array(kinds)
    values = np.where(selector == -1, 1, np.array(COUNTS)[np.maximum(selector, 0)])
    start = np.cumsum(values) - values
    out = np.zeros(int(values.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        rows = selector == s
        if s == -1:
            out[start[rows]] = words[rows]
        elif s:
            width = 60 // COUNTS[s]
            for k in range(COUNTS[s]):
                out[start[rows] + k] = (words[rows] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out[:count]


def block_bytes(before: int, docs: list[tuple[int, int]], ids: np.ndarray) -> bytes:
    words = pack(ids)
    head = np.array([MAGIC, before, len(docs), len(ids), len(words)], "<u8")
    table = np.array(docs, "<i8").reshape(-1, 2)
    return head.tobytes() + table.tobytes() + words.astype("<u8").tobytes()


def blocks_of(content: bytes) -> Iterator[tuple[int, list, np.ndarray]]:
    """Ids before the block, its documents, and its ids, for each block of a file."""
    at = 0
    while at < len(content):
        magic, before, n_docs, n_ids, n_words = np.frombuffer(content, "<u8", 5, at).tolist()
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        table = np.frombuffer(content, "<i8", 2 * n_docs, at + 40).reshape(-1, 2).tolist()
        at += 40 + 16 * n_docs
        yield before, table, unpack(np.frombuffer(content, "<u8", n_words, at), n_ids)
        at += 8 * n_words + len(TRAILER)


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0, block: int = BLOCK) -> None:
    """The ids of every text, each followed by ``end_id``, in files of ascending ``doc_id`` (null first).

    ``docs`` has ``doc_id`` (a whole number) and ``text``; other columns are ignored, a null text is empty, and equal
    rows are written as often as they come, equal ids in the order of a hash of their texts. ``path`` is the JSON file
    of the tokenizer. The number of files follows ``spark.sql.shuffle.partitions`` and adaptive merging; they
    sort by name as their rows do. A file must stay under 2 GB.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, before, table, waiting, held = unit_memory(path), 0, [], [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, GROUP):
                group = batch.slice(low, GROUP)
                for key, ids in zip(group.column("doc_id").to_pylist(), memory.texts(group.column("text").to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    while len(ids):
                        part = ids[:block - held]
                        ids = ids[len(part):]
                        table.append((key or 0, len(part) * 4 + 2 * (key is None) + (len(ids) > 0)))
                        waiting.append(part)
                        held += len(part)
                        if held == block:
                            yield pa.record_batch([pa.array([block_bytes(before, table, np.concatenate(waiting))], pa.binary())], ["block"])
                            before, table, waiting, held = before + held, [], [], 0
        if held:
            yield pa.record_batch([pa.array([block_bytes(before, table, np.concatenate(waiting))], pa.binary())], ["block"])

    blocks = rows.mapInArrow(encode, "block binary").select(F.col("block").cast("string"))
    blocks.write.option("lineSep", TRAILER).text(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``file``, ``doc_id``, ``in_file`` (ids before it there), ``n_tokens``, ``ids_crc32``.

    The checksum is that of the ids as little-endian unsigned 32-bit integers. With ``with_ids`` the ids follow.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                start, crc, count, kept, rows = 0, 0, 0, [], []
                for before, table, ids in blocks_of(content.as_py()):
                    at = 0
                    for key, packed in table:
                        if not count:
                            start = before + at
                        part = ids[at:at + (packed >> 2)].astype("<u4")
                        at += len(part)
                        count, crc = count + len(part), zlib.crc32(part.tobytes(), crc)
                        if with_ids:
                            kept.append(part)
                        if not packed & 1:
                            rows.append((file, None if packed & 2 else key, start, count, crc, *([np.concatenate(kept)] if with_ids else [])))
                            crc, count, kept = 0, 0, []
                    yield record(rows)
                    rows = []

    kinds = [("file", pa.string()), ("doc_id", pa.int64()), ("in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int64()))] * with_ids

    def record(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    schema = "file string, doc_id long, in_file long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInArrow(decode, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of ``docs`` to a new folder and reads it: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` is the number of ids of all documents before it, end ids included. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    write_ids(docs, path, folder, end_id)
    read = staged(read_ids(spark, folder))
    # One row per file; its ids before are summed in the order of the names.
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn(
        "earlier", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return read.join(files, "file").select("doc_id", (F.col("in_file") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32")
