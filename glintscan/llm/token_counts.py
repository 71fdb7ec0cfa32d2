"""Token counts of texts of any length, by chunks that overlap and are spliced at proven boundaries.

A chunk reaches ``overlap`` characters into the next one. The tokenizer splits a text from left to right into
matches of a pattern that never looks back, and merges within a match only. So once two scans both start a match at
one place, they agree from there on, as far as both see the same text. The first chunk starts where the text
starts; each chunk is right from its left splice on and up to ``MARGIN`` characters before its end (the pattern
looks one character ahead, and a special token cut by the end could be one). A place in the overlap where the left
chunk has such a boundary and the right chunk has one too is therefore a boundary of the whole text, and the right
chunk is right from there: the splice. Where an overlap has no common boundary (say, a run of letters longer than
it), the document goes to another round with chunks and overlaps four times as long, in the end as one chunk.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged
from .units import WHITE, WHITE_CHARACTERS, UnitMemory, kept_in_worker, packed, portions

CHUNK = 16_384
OVERLAP = 512
#: More characters than any special token has, and one that the pattern looks ahead.
MARGIN = 32
WIDEN = 4


def tokenizer(path: str):
    """The tokenizer of a JSON file, working in the calling thread only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Characters of units that are encoded as one text.
JOINED = 4_000
#: A unit that a line feed before it leaves as it is: the pattern ends a run of white space before its last space.
PLAIN = re.compile(f" [^{WHITE}]+")


def encode_units(tok, units: list[str]) -> list[bytes]:
    """The ids of every unit; an empty one has none.

    Plain units are encoded many at a time with a line feed between them, which is a match of its own there and no part of
    any of them, so its id tells where each ends. Others that start with white space and end with another character are
    encoded one after the other: each starts at a boundary of the joined text, so its ids are those between its own
    characters.
    """
    mark = tok.encode("\n", add_special_tokens=False).ids
    plain = list(filter(PLAIN.fullmatch, units)) if len(mark) == 1 else []
    parts, found = list(portions(plain, JOINED)), {}
    for part, enc in zip(parts, tok.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False), strict=True):
        ids = np.array(enc.ids, "<u4")
        cuts = (4 * np.flatnonzero(ids == mark[0])).tolist()
        ids = ids.tobytes()
        found.update(zip(part, [ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)], strict=True)], strict=True))
    apart, joined = [], []
    for u in units if len(found) < len(units) else []:
        if u not in found:
            (apart if u[:1] not in WHITE_CHARACTERS or u[-1] in WHITE_CHARACTERS else joined).append(u)
    found.update(zip(apart, (packed(e.ids) for e in tok.encode_batch_fast(apart, add_special_tokens=False)), strict=True))
    parts = list(portions(joined, JOINED))
    for part, enc in zip(parts, tok.encode_batch(["".join(p) for p in parts], add_special_tokens=False), strict=True):
        starts = np.fromiter((a for a, _ in enc.offsets), np.int64)
        ids = np.array(enc.ids, "<u4").tobytes()
        cuts = [*(4 * np.searchsorted(starts, np.cumsum([0, *map(len, part[:-1])]))).tolist(), len(ids)]
        found.update((u, ids[a:b]) for u, a, b in zip(part, cuts, cuts[1:], strict=False))
    return [found[u] for u in units]


def unit_memory(path: str) -> UnitMemory:
    """Ids of texts by the tokenizer of a JSON file; a worker keeps it from task to task."""
    def make() -> UnitMemory:
        tok = tokenizer(path)
        special = "".join(t.content for t in tok.get_added_tokens_decoder().values())
        return UnitMemory(lambda units: encode_units(tok, units), "".join(c for c in string.punctuation if c not in special))

    return kept_in_worker(("tokenizer", path), make)


def chunk_boundaries(ids: int, starts: np.ndarray, words: np.ndarray, begin: int, low: int, high: int) -> tuple[list, list]:
    """Places from ``low`` to ``high`` where a match of the chunk at ``begin`` starts, and the tokens before each."""
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if ids else np.zeros(0, int)
    place = starts[first] + begin
    take = (place >= low) & (place <= high)
    return place[take].tolist(), first[take].tolist()


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row, as the tokenizer at ``path`` gives them.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A null text counts as empty: 0 bytes and
    0 tokens. Null and repeated ids keep a row each. ``path`` must exist on every executor, as installed packages do.
    """
    if not MARGIN < overlap <= chunk // 2:
        raise ValueError("overlap must be over the margin and at most half a chunk")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = unit_memory(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            near = [t if len(t) <= chunk else "" for t in texts]
            counts = [len(i) // 4 for i in memory.texts(near)]
            yield pa.record_batch([
                batch.column("row_id"), batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([n if len(t) <= chunk else None for n, t in zip(counts, texts, strict=True)], pa.int64()),
                pa.array([None if len(t) <= chunk else t for t in texts], batch.column("text").type)],
                ["row_id", "doc_id", "n_bytes", "n_tokens", "text"])

    counted = staged(rows.mapInArrow(short, f"row_id long, doc_id {id_type}, n_bytes long, n_tokens long, text string"))
    todo, done = counted.filter("text IS NOT NULL").select("row_id", "text"), []
    while not todo.isEmpty():
        result = staged(spliced(todo, path, chunk, overlap))
        done.append(result.filter("n_tokens IS NOT NULL"))
        todo = todo.join(result.filter("n_tokens IS NULL").select("row_id"), "row_id", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    out = counted.drop("text")
    if done:
        long = done[0]
        for more in done[1:]:
            long = long.unionByName(more)
        out = out.join(long.withColumnRenamed("n_tokens", "n_long"), "row_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", "n_long"))
    return out.select("doc_id", "n_bytes", "n_tokens")


def spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``n_tokens`` by ``row_id``; null where two neighbouring chunks have no common boundary in their overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = [s for s in range(0, len(text), chunk) if not s or s + overlap < len(text)]
                for at in range(0, len(starts), 64):
                    part = starts[at:at + 64]
                    yield pa.record_batch([
                        pa.array([row] * len(part), pa.int64()), pa.array([s // chunk for s in part], pa.int32()), pa.array([s == starts[-1] for s in part]),
                        pa.array([text[s:] if s == starts[-1] else text[s:s + chunk + overlap] for s in part], pa.string())],
                        ["row_id", "chunk", "last", "piece"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            out = []
            for row, k, last, piece in zip(*(batch.column(c).to_pylist() for c in ("row_id", "chunk", "last", "piece")), strict=True):
                enc = tok.encode(piece, add_special_tokens=False)
                n, begin = len(enc.ids), k * chunk
                starts = np.array(enc.offsets, np.int64).reshape(-1, 2)[:, 0]
                words = np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
                left = chunk_boundaries(n, starts, words, begin, begin, begin + overlap - MARGIN) if k else ([], [])
                right = ([], []) if last else chunk_boundaries(n, starts, words, begin, begin + chunk, begin + chunk + overlap - MARGIN)
                out.append((row, k, last, n, *left, *right))
            names = ["row_id", "chunk", "last", "n", "left_at", "left_n", "right_at", "right_n"]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 4]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    chunks = (
        rows.mapInArrow(cut, "row_id long, chunk int, last boolean, piece string").repartition("row_id", "chunk")
        .mapInArrow(encode, "row_id long, chunk int, last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")
    )
    by_row = Window.partitionBy("row_id").orderBy("chunk")  # a text is at most 2 GB, so a row has a bounded number of small rows here
    tokens_at = lambda at, n, place: F.element_at(F.map_from_arrays(at, n), place)
    chunks = (
        chunks.withColumn("next_at", F.lead("left_at").over(by_row))
        .withColumn("splice", F.array_min(F.array_intersect("right_at", "next_at")))
        .withColumn("before", F.lag("splice").over(by_row))
        .withColumn("tokens", F.when(F.col("last"), F.col("n")).otherwise(tokens_at("right_at", "right_n", F.col("splice")))
                    - F.when(F.col("chunk") == 0, F.lit(0)).otherwise(tokens_at("left_at", "left_n", F.col("before"))))
    )
    return chunks.groupBy("row_id").agg(F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("n_tokens"))
