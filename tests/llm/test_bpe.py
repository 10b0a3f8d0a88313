import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, tricky
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keytide.llm import bpe, common, token_files

ODD = ["", " ", "  a", "a  b", "a \n b", " \n", "x<|endoftext|>y<|endoftext|>", "aaaaaaaaa", "don't I'LL", "é́ ñ 漢字 😀 🤦🏽‍♂️", "\x00\x01 b　c", "1234½²", "a b \x85 c", "İΣ ς", "\x1cA\x1fb"]


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def word_lib():
    return Tokenizer.from_file(token_files.default_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab 's\n\t<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_byte_ids_are_the_librarys(texts):
    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert [own.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]


def test_byte_ids_of_odd_texts(byte_lib):
    own = bpe.ByteBPE(bpe.default_path())
    want = [e.ids for e in byte_lib.encode_batch(ODD, add_special_tokens=False)]
    assert own.encode(ODD) == want
    halves = [i[: len(i) // 2] for i in want]
    assert [own.decode(i) for i in halves] == [byte_lib.decode(i, skip_special_tokens=False) for i in halves]
    assert own.decode([10**6, -1]) == ""


def test_memo_turns_over(byte_lib, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 20)
    own, rng = bpe.ByteBPE(bpe.default_path()), random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(30)) for _ in range(20)]
    for k in range(0, 20, 4):
        assert own.encode(texts[k : k + 4]) == [e.ids for e in byte_lib.encode_batch(texts[k : k + 4], add_special_tokens=False)]


def test_query_columns(spark, byte_lib):
    rows = tricky()
    path = bpe.default_path()
    got = bpe.digests(bpe.decode(bpe.encode(documents(spark, rows), path), path)).collect()
    want = []
    for i, t in rows:
        ids = byte_lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    once = bpe.round_trip(documents(spark, rows), path)
    assert once.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(documents(spark, []), path).count() == 0 and bpe.round_trip(documents(spark, []), path).count() == 0


def test_white_space_beyond_ascii(byte_lib, word_lib):
    """Every white space and sign near it, alone and doubled, before a space and after."""
    own, words = bpe.ByteBPE(bpe.default_path()), token_files.PieceEncoder(token_files.default_path())
    odd = [chr(c) for c in [*range(33), 0x7F, *range(0x80, 0x180), 0x1680, 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0x3001, 0xFEFF]]
    texts = [f"a{c} b {c} d{c}{c}  e{c}" for c in odd]
    assert own.encode(texts) == [e.ids for e in byte_lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, words.packed).tolist() for x in words.encode_packed(texts)] == [e.ids for e in word_lib.encode_batch(texts, add_special_tokens=False)]


def test_long_pieces_and_slices(byte_lib, monkeypatch):
    monkeypatch.setattr(common, "TEXT_BYTES", 50)
    monkeypatch.setattr(common, "TEXT_ROWS", 3)
    own = bpe.ByteBPE(bpe.default_path())
    texts = ["x" * 3000, None, "漢字" * 500, "", "short", "a b c", "word " * 40, *"abcdefg"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.text_slices([batch], 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts))) and all(0 < p.num_rows <= 3 for p in parts) and len(parts) >= 6
    got = [x for p in parts for x in own.encode([t or "" for t in p.column(1).to_pylist()])]
    assert got == [byte_lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not any(len(p) > bpe.MEMO_BYTES for p in own.memo)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aB 's\n\t.,<|endoftext|>é"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_word_ids_are_the_librarys(texts):
    lib, own = Tokenizer.from_file(token_files.default_path()), token_files.encoder(token_files.default_path())
    assert [np.frombuffer(x, own.packed).tolist() for x in own.encode_packed(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_of_odd_texts(word_lib, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_PIECES", 5)
    own = token_files.PieceEncoder(token_files.default_path())
    for some in (ODD[:7], ODD[7:], ODD):
        assert [np.frombuffer(x, own.packed).tolist() for x in own.encode_packed(some)] == [e.ids for e in word_lib.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=600))
def test_blocks_roundtrip(ids):
    x = np.array(ids, np.int64)
    cut = len(ids) // 3
    s = token_files.Segment(token_files.encode_segment(np.array([5, -(2**63)]), np.array([cut, len(ids) - cut]), x))
    assert s.read().tolist() == ids and s.document(0).tolist() == ids[:cut] and s.document(1).tolist() == ids[cut:]


def test_bad_segment():
    with pytest.raises(ValueError, match="segment"):
        token_files.Segment(b"nope" + b"\0" * 40)


def test_files(spark, word_lib, monkeypatch, tmp_path):
    import zlib

    rows = tricky()
    docs = documents(spark, rows)
    path = token_files.default_path()
    token_files.write(docs, f"{tmp_path}/tokens", path)
    got = token_files.documents(token_files.read(spark, f"{tmp_path}/tokens")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = word_lib.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == [tuple(w) for w in want]
    assert token_files.documents(token_files.segments(documents(spark, []), path)).count() == 0
