import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entitylake.llm import token_files
from entitylake.llm.common import shared_folder
from tests.llm.tables import awkward_rows, documents, prose


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.public_tokenizer())


def plain(rows, tokenizer):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, out = 0, []
    for doc_id, text, *_ in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tokenizer):
    rows = awkward_rows() + [(500, "x<|endoftext|>y <|endoftext|> z", "", "", 1), (501, "it's  two  spaces  x 'll we'll", "", "", 1)]
    df = documents(spark, rows).withColumn("start", F.lit("x")).repartition(3)
    got = token_files.round_trip(df).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain(rows, tokenizer)


def test_empty(spark):
    assert token_files.round_trip(documents(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="st.,-(ab'  \n\t.é漢 　\x85<|>1", max_size=30), max_size=6))
def test_pieces_give_the_tokenizers_ids(texts):
    encoder = token_files.encoder(token_files.public_tokenizer())
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, counts = encoder.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for x in expected for i in x]
    assert counts.tolist() == [len(x) for x in expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "it's", "we'll", "x", "9", ".", ",", "'s", "'", "|", "<", " ", "  ", "\n", "end", "é", "漢"]), max_size=14))
def test_pieces_around_marks_and_added_tokens(parts):
    encoder = token_files.encoder(token_files.public_tokenizer())
    raw = "".join(parts).encode()
    ids, _ = encoder.encode(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == encoder.tokenizer.encode(raw.decode(), add_special_tokens=False).ids + [2]


def test_forgetting_changes_no_result(monkeypatch, tokenizer):
    monkeypatch.setattr("entitylake.llm.span_cache.REMEMBERED", 40)
    encoder = token_files.Encoder(token_files.public_tokenizer())
    for i in range(30):
        raw = (prose(i % 7, 30) + " often often, often " + prose(100 + i, 20)).encode()
        ids, _ = encoder.encode(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == tokenizer.encode(raw.decode(), add_special_tokens=False).ids + [2]
    known = len(encoder.pieces.known)
    encoder.pieces._forget()
    assert len(encoder.pieces.known) == known // 2
    monkeypatch.setattr("entitylake.llm.span_cache.REMEMBERED", 1000)
    raw = b"a often often"
    encoder.pieces.ids(np.frombuffer(raw, dtype=np.uint8), np.array([1]), np.array([7]))
    assert len(encoder.pieces.known) == known // 2, "a span in steady use is remembered"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1) | st.integers(0, 50), max_size=1200))
def test_blocks(values):
    ids = np.array(values, dtype=np.uint32)
    data = b"".join(token_files.pack(ids))
    back, at = [], 0
    while at < len(data):
        block, at = token_files.unpack(data, at)
        back += block.tolist()
    assert back == values


def test_outliers_are_exceptions():
    ids = np.full(token_files.BLOCK, 7, dtype=np.uint32)
    ids[3] = 50_000
    (block,) = token_files.pack(ids)
    assert len(block) < 20 and token_files.unpack(block, 0)[0].tolist() == ids.tolist()


def test_ranges_are_read_by_the_index(spark, tokenizer):
    folder = f"{shared_folder(spark)}/ids"
    rows = [(i, prose(i, 200), "", "", 1) for i in range(40)]
    files = token_files.write_token_files(documents(spark, rows), folder).collect()
    fs, base = pafs.FileSystem.from_uri(folder)
    everything = np.concatenate([tokenizer.encode(t, add_special_tokens=False).ids + [2] for _, t, *_ in rows])
    for f in files:
        reader = token_files.Reader(fs, f"{base}/{f.file}")
        assert reader.n_ids == f.n_ids and int(reader.counts.sum()) == f.n_ids
        for a, z in ((0, 1), (5, 5), (500, 530), (f.n_ids - 3, f.n_ids), (0, f.n_ids)):
            assert reader.ids(a, z).tolist() == everything[f.first + a : f.first + z].tolist()


def test_no_such_file(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        token_files.Reader(pafs.LocalFileSystem(), str(tmp_path / "x"))
