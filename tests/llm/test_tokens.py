from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orderscope.llm import token_file, token_units
from orderscope.llm.queries import QUERIES
from orderscope.llm.token_counts import Counter, count_tokens, proven_tokens, vocabulary
from orderscope.llm.token_file import Encoder, Reader, Writer, from_planes, read_token_files, to_planes, write_token_files

SF_SMALL = "/root/testdata/sf0.001"
ODD = [
    "", None, "  a  b ", " a", "  ", " ", "a  ", "\n foo", "a \n b", "a  \nb", "a\n  b c", "a\t \tb", "a   b    c",
    "x <|endoftext|> y<|startoftext|>z", "<|endoftext|>", "İstanbul ŉ ſ Σίσυφος ΣΑΣ", "áb é á", "\x1c a \x1c b\x85 c \xa0 d",
    "it's I'LL don''s !!'s ?'", "１２３ ½ ² Ⅷ", "日本語 text 😀😀", "'S 'RE", "tab\tnew\nline\x1cq\x85r\xa0s", "x" * 5000,
]


@pytest.fixture(scope="module")
def words():
    path = vocabulary()
    return Counter(path, proven_tokens(path)), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def bytes_():
    path = vocabulary("byte_bpe_50k.json")
    return Encoder(path), Tokenizer.from_file(path)


def encoded(encoder, texts):
    out = []
    for _, lengths, ids in encoder(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    return out


def library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_odd_texts(words, bytes_):
    counter, tokenizer = words
    assert counter(pa.array(ODD)).tolist() == [len(library(tokenizer, t)) for t in ODD]
    encoder, tokenizer = bytes_
    assert encoded(encoder, ODD) == [library(tokenizer, t) + [0] for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\x1c\x85\xa0aZé'!1²<|>İ日́"), max_size=30), min_size=1, max_size=4))
def test_any_text(words, bytes_, texts):
    counter, tokenizer = words
    assert counter(pa.array(texts)).tolist() == [len(library(tokenizer, t)) for t in texts]
    encoder, tokenizer = bytes_
    assert encoded(encoder, texts) == [library(tokenizer, t) + [0] for t in texts]


def test_a_full_cache_changes_nothing(bytes_, monkeypatch):
    monkeypatch.setattr(token_units, "CACHE_UNITS", 3)
    monkeypatch.setattr(token_units, "SLICE_BYTES", 20)
    texts = [f"word{i % 5} and{i} more. " for i in range(50)]
    encoder = Encoder(vocabulary("byte_bpe_50k.json"))
    assert encoded(encoder, texts) == [library(bytes_[1], t) + [0] for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32 if n < 9 else 50_000, n).astype(np.uint32)
        planes = to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4)
        assert (from_planes(planes, n) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 100)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 250, 99, 100, 3)]
    out = io.BytesIO()
    writer = Writer(out, pa.int64(), bits)
    for i, ids in enumerate(docs):
        writer.add(pa.array([i]), np.array([len(ids)]), ids)
    assert writer.close() == sum(map(len, docs))
    path = tmp_path / "x.pln"
    path.write_bytes(out.getvalue())
    with pa.OSFile(str(path)) as source:
        reader = Reader(source)
        whole = np.concatenate(docs)
        assert [c["ids"] for c in reader.chunks][:-1] == [100] * (len(reader.chunks) - 1)
        for a, b in ((0, len(whole)), (5, 6), (95, 205), (300, 300)):
            assert (reader.ids(a, b) == whole[a:b]).all()
        assert [n for b in reader.documents() for n in b.column("n").to_pylist()] == [len(d) for d in docs]
    with pytest.raises(ValueError):
        Reader(pa.BufferReader(b"\0" * 100))


def test_counts_of_awkward_rows(awkward, nothing, words):
    rows = count_tokens(awkward, limit=3).collect()
    assert len(rows) == 12
    for r in rows:
        n = len(library(words[1], r["text"]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 3)
    assert count_tokens(nothing).count() == 0


def test_files_of_awkward_rows(spark, awkward, nothing, bytes_, tmp_path):
    manifest = write_token_files(awkward, str(tmp_path / "a"))
    rows = sorted(read_token_files(spark, manifest, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    at = 0
    for r in rows:
        ids = library(bytes_[1], texts[r["doc_id"]]) + [0]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = write_token_files(nothing, str(tmp_path / "b"))
    assert read_token_files(spark, empty, str(tmp_path / "b")).count() == 0


def test_queries_equal_the_library(spark, words, bytes_):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    counted = {r["doc_id"]: r for r in QUERIES["op3_whole_tokens"](spark, SF_SMALL).collect()}
    written = {r["doc_id"]: r for r in QUERIES["op5_bit_planes"](spark, SF_SMALL).collect()}
    at = 0
    for d in docs:
        n = len(library(words[1], d["text"]))
        c = counted[d["doc_id"]]
        assert (c["n_bytes"], c["n_tokens"], c["over_limit"]) == (len((d["text"] or "").encode()), n, n > 2048)
        ids = library(bytes_[1], d["text"]) + [0]
        w = written[d["doc_id"]]
        assert (w["start"], w["n_tokens"]) == (at, len(ids))
        assert w["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
