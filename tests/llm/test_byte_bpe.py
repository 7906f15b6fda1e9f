"""Byte-level BPE against the tiktoken library, and its round trip."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gearsight.llm import bytebpe, queries

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, word string, block long, place int, row string, kind string"
TEXTS = ["", None, "plain words, plain words", "  two  spaces \n\n\t end  ", "<|endoftext|> is text", "don't we'll 12345 ½ Ⅷ",
         "日本語 と русский é ​\u0085\x1c\x00", "x" * 3000, "word " * 30000, " ".join(f"w{i}" for i in range(20000)),
         "\U0001f600\U0001f468‍\U0001f469", "plain words, plain words"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS),
                             special_tokens={})


def rows_of(spark, tables, texts):
    rows = [(i if i != 5 else None, t, "a", None, 7, 1, "r", "doc") for i, t in enumerate(texts)]
    return tables(spark, rows, SCHEMA)


def ids_of(data):
    return np.frombuffer(bytes(data), "<u4").tolist()


@pytest.mark.parametrize("tokens,words", [(8_000_000, 1_000_000), (10, 5)])
def test_equals_the_library(spark, tables, library, monkeypatch, tokens, words):
    monkeypatch.setattr(bytebpe, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(bytebpe, "BLOCK_WORDS", words)
    docs = rows_of(spark, tables, TEXTS)
    out = bytebpe.decode(bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    both = bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN, round_trip=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, out.collect()))
    assert out.columns == ["doc_id", "word", "block", "place", "row", "kind", "n_tokens", "ids", "decoded"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i if i != 5 else None]
        assert ids_of(r.ids) == library.encode_ordinary(text or "") and r.n_tokens == len(ids_of(r.ids))
        assert bytes(r.decoded) == (text or "").encode() and (r.row, r.block, r.word) == ("r", 7, None)


def test_repeated_rows_and_empty_tables(spark, tables):
    docs = rows_of(spark, tables, TEXTS[2:4])
    twice = bytebpe.encode(docs.unionByName(docs), RANKS, public_tokenizers.PATTERN)
    assert twice.count() == 4 and twice.dropDuplicates().count() == 2
    none = bytebpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert bytebpe.decode(none, RANKS).count() == 0
    blank = bytebpe.encode(rows_of(spark, tables, ["", None]), RANKS, public_tokenizers.PATTERN)
    assert [(r.n_tokens, bytes(r.ids)) for r in blank.collect()] == [(0, b"")] * 2


def test_decoding_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, np.array([0, 4_000_000_000], "<u4").tobytes()), (2, None), (3, b"")],
                                 "id long, ids binary")
    got = {r.id: r.decoded for r in bytebpe.decode(rows, RANKS).collect()}
    token = {i: t for t, i in bytebpe.read_ranks(RANKS).items()}[0]
    assert bytes(got[1]) == token and got[2] is None and bytes(got[3]) == b""


def test_short_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**33 - 1, 5])
    cells = bytebpe.shortened(values, np.array([0, 0, 4, 10]))
    raw = [np.frombuffer(c, np.uint8) for c in cells]
    assert [bytebpe.restored(r).tolist() for r in raw] == [[], values[:4].tolist(), values[4:].tolist()]
    assert bytebpe.restored(np.concatenate(raw)).tolist() == values.tolist()


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op13_byte_bpe"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
