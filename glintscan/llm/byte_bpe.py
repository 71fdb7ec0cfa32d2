"""Byte-level BPE through a sentencepiece model that is written from the vocabulary itself.

Each token's bytes become a piece of printable characters, one character a byte, with the negative rank as its score;
so the library, which always merges the pair of the highest score and the leftmost of equals, merges as the ranks
say. The model normalises nothing. It encodes pre-tokens (matches of a pattern), each by itself; decoding maps
the pieces' characters back to bytes. The model is a few fields of a protocol buffer, written here directly.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .units import UnitMemory, kept_in_worker, packed

#: Byte ranges that stand for themselves as characters; the others follow from code point 256 on.
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Fixed values of the model format: field numbers and enumeration values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE, VOCAB_SIZE = 3, 2, 4
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def byte_characters() -> str:
    """The character of every byte, in the order of the bytes."""
    own = {b for r in PRINTABLE for b in r}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def message(field: int, content: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(content)) + content


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a token in base 64 and its rank in every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece 0 is the unknown piece that the format demands, piece i + 1 the i-th rank."""
    shown = byte_characters()
    out = [message(PIECES, message(PIECE_TEXT, b"<unk>") + number(PIECE_TYPE, UNKNOWN))]
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = "".join(shown[b] for b in token).encode()
        out.append(message(PIECES, message(PIECE_TEXT, piece) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank)))
    out.append(message(TRAINER, number(MODEL_TYPE, BPE) + number(VOCAB_SIZE, len(ranks) + 1)))
    out.append(message(NORMALIZER, message(NAME, b"identity") + number(DUMMY_PREFIX, 0) + number(EXTRA_SPACES, 0) + number(ESCAPE_SPACES, 0)))
    return b"".join(out)


class Codec:
    """Encodes texts and decodes ids with a serialised model; ``ranks`` are the ids of its pieces from the second on."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.shown = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.shown.items()}
        pieces = (self.processor.id_to_piece(i + 1) for i in range(len(ranks)))
        self.tokens = {int(rank): bytes(back[c] for c in piece) for rank, piece in zip(ranks, pieces, strict=True)}
        self.memory = UnitMemory(self._units)

    def _units(self, units: list[str]) -> list[bytes]:
        """Each pre-token of the units by itself."""
        out = []
        for low in range(0, len(units), 5_000):
            split = [self.split(u) for u in units[low:low + 5_000]]
            flat = [t.encode().decode("latin-1").translate(self.shown) for pre in split for t in pre]
            ids = iter(self.processor.encode(flat, num_threads=1))
            out += [packed(self.ranks[np.array([i for _ in pre for i in next(ids)], np.int64) - 1].tolist()) for pre in split]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        return self.memory.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, and of every text ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (bytes).

    ``decoded`` is made from the ids alone. With ``digests``, the two are given as ``ids_sha256`` and ``decoded_sha256`` instead. ``docs``
    has ``doc_id`` and ``text``; other columns are ignored, a null text is empty, and every row gives a row, null and
    repeated ids too. ``ranks_path`` is read by the driver.
    """
    ranks = read_ranks(ranks_path)
    model, order = sentencepiece_model(ranks), np.array(sorted(ranks.values()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("codec", ranks_path, pattern), lambda: Codec(model, order, pattern))
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids = codec.encode(part.column("text").to_pylist())
                if digests:
                    made = [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])]
                else:
                    made = [pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *made], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kind = "string" if digests else "binary"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, {names[2]} {kind}, {names[3]} {kind}")
