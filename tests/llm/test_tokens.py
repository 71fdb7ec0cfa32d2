"""Token counts, token files and byte-level BPE against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from glintscan.llm import byte_bpe, simple8b, token_counts
from glintscan.llm.queries import JSON, PATTERN, RANKS
from glintscan.llm.units import UNIT, WHITE_CHARACTERS, UnitMemory, pieces, units_of

SCHEMA = "doc_id long, text string"
LONG = "abc  def\n" * 900 + "x" * 9_000 + " tail <|endoftext|> more  " * 300 + "\n" * 4_000 + "é" * 2_000 + "1234" * 800
ROWS = [(3, LONG), (2, None), (5, ""), (None, "none's id"), (3, LONG), (7, "a\x1c  b\x85 c　 d"), (1, " " * 3_000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def bpe():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_units_are_independent(library):
    memory = token_counts.unit_memory(JSON)
    rng = random.Random(5)
    odd = [chr(i) for i in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = ["".join(rng.choices([*odd, "a", "b's", "1", "é", ".", "<|endoftext|>", " "], k=40)) for _ in range(3_000)]
    texts += [f"z{c}  b {c} {c}{c}\n c{c} x" for c in odd]
    for text, ids in zip(texts, memory.texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
        assert "".join(UNIT.findall(text)) == text
    assert all(c in WHITE_CHARACTERS for c in " \n\t　") and "\x1c" not in WHITE_CHARACTERS


@given(st.text(alphabet=st.sampled_from("ab  \n.é1"), max_size=200), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_pieces_keep_the_text(text, chars):
    assert "".join(pieces(text, chars)) == text


def test_words_need_the_tokenizer_once():
    asked = []
    memory = UnitMemory(lambda units: asked.extend(units) or [u.encode("utf-32-le") for u in units], limit=40)
    texts = ["a word, word. (word) word!\nword", "", " word, ", *(f" word x{k}, x{k}\t{'y' * 70}{k}." for k in range(60))]
    for _ in range(3):
        for text in texts:
            assert memory.texts([text, text]) == [text.encode("utf-32-le")] * 2
    assert asked.count(" word") == asked.count(",") == 1  # met all the time, so never forgotten, with punctuation or without
    assert len(memory.known) <= 40 and len(memory.old) <= 40


@given(st.text(alphabet=st.sampled_from("ab  \n\t\0.,'<|>é1…１"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_units_of_any_text(library, text):
    memory = token_counts.unit_memory(JSON)
    for t in (text, text + "<|endoftext|>, a.", " a, " + text):
        assert "".join(units_of([t, "b"])[0].as_py()) == t
        assert np.frombuffer(memory.texts([t])[0], "<u4").tolist() == ids_of(library, t)


@pytest.mark.parametrize("chunk, overlap", [(256, 64), (1_024, 128), (16_384, 512)])
def test_counts(table, library, chunk, overlap):
    got = sorted(map(tuple, token_counts.count_tokens(table(ROWS, SCHEMA), JSON, chunk, overlap).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), len(ids_of(library, t))) for i, t in ROWS], key=str)


def test_counts_of_documents(documents, library):
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents, JSON, 512, 64).collect()}
    assert got == {r.doc_id: len(ids_of(library, r.text)) for r in documents.collect()}
    assert token_counts.count_tokens(documents.limit(0), JSON).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(documents, JSON, 100, 80)


@pytest.mark.parametrize("high", [1, 2, 300, 50_257, 2**31, 2**60, 2**64 - 1])
def test_words_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 2, 59, 60, 61, 5_000):
        values = rng.integers(0, high, n, dtype=np.uint64)
        values = np.where(rng.random(n) < 0.5, values, values % np.uint64(2))
        assert (simple8b.unpack(simple8b.pack(values), n) == values).all()


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=200))
@settings(max_examples=200, deadline=None)
def test_words_round_trip_of_any_values(values):
    assert simple8b.unpack(simple8b.pack(np.array(values, np.uint64)), len(values)).tolist() == values


def test_words_are_dense():
    assert len(simple8b.pack(np.zeros(600, np.uint64))) == 10
    assert len(simple8b.pack(np.full(10, 2**61, np.uint64))) == 20


@pytest.mark.parametrize("block", [16, 65_536])
def test_files(spark, table, library, tmp_path, block):
    folder = str(tmp_path / "ids")
    simple8b.write_ids(table(ROWS, SCHEMA), JSON, folder, block=block)
    read = sorted(simple8b.read_ids(spark, folder, with_ids=True).collect(), key=lambda r: (r.file, r.in_file))
    assert [r.doc_id for r in read] == [None, 1, 2, 3, 3, 5, 7]
    want = {i: ids_of(library, t) + [0] for i, t in ROWS}
    for r in read:
        assert r.ids == want[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_files_of_documents(documents, library):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.token_files(documents, JSON).collect()}
    start, want = 0, {}
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = np.array([*ids_of(library, r.text), 0], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    assert simple8b.token_files(documents.limit(0), JSON).collect() == []


def test_bpe(table, documents, bpe):
    for df in (table(ROWS, SCHEMA), documents.select("doc_id", "text")):
        got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode(df, RANKS, PATTERN, digests=True).collect()], key=str)
        want = []
        for r in df.collect():
            ids = np.array(bpe.encode_ordinary(r.text or ""), "<u4")
            want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    real = byte_bpe.encode(table(ROWS[:1], SCHEMA), RANKS, PATTERN).first()
    assert real.decoded.decode() == LONG and np.frombuffer(real.ids, "<u4").tolist() == bpe.encode_ordinary(LONG)
    assert byte_bpe.encode(documents.limit(0), RANKS, PATTERN).collect() == []


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_bpe_of_any_text(bpe, text):
    codec = test_bpe_of_any_text.__dict__.setdefault("codec", None)
    if codec is None:
        ranks = byte_bpe.read_ranks(RANKS)
        codec = test_bpe_of_any_text.codec = byte_bpe.Codec(byte_bpe.sentencepiece_model(ranks), np.array(sorted(ranks.values())), PATTERN)
    ids = codec.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == bpe.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_the_multilingual_ranks_work_too(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    text = "Größe наука 日本語 naïve " * 20
    got = byte_bpe.encode(spark.createDataFrame([(1, text)], SCHEMA), path, PATTERN).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == own.encode_ordinary(text) and got.decoded.decode() == text
