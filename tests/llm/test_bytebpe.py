"""Byte-level BPE against the library that the vocabulary belongs to."""

from __future__ import annotations

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quillmark.llm import bytebpe as B


@pytest.fixture(scope="module")
def tokens():
    return B.read_ranks(B.vocabulary_path())


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=B.pattern(), mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def texts(seed=3):
    r = random.Random(seed)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "’s", "é", "é", "東京", "😀", "İ", "\x00", "\x1c", "\x85", "　", "123", "٣", "½", "<|endoftext|>", "_", "...", "﻿", "zzqx"]
    found = ["".join(r.choice(signs) for _ in range(r.randint(1, 60))) for _ in range(400)]
    found += ["".join(chr(c) for c in (r.randrange(1, 0x2FFFF) for _ in range(40)) if not 0xD800 <= c < 0xE000) for _ in range(100)]
    return [None, "", " ", "\n\n", "   x", "x   ", "a" * 3000, "ab" * 1500, " " * 500, *found, found[0]]


def test_the_hash_is_minimal_and_perfect(tokens):
    h = B.PerfectHash(tokens)
    assert sorted(h.at) == list(range(len(tokens)))
    assert all(h.find(t) == i for i, t in enumerate(tokens))
    c = B.Coder(tokens, h, B.pattern())
    assert c.rank(b"no such token at all") == c.rank(b"") == c.rank(b"x" * 500) == -1
    for n in (0, 1, 2, 7):
        small = B.PerfectHash(tokens[:n])
        assert [small.find(t) for t in tokens[:n]] == list(range(n))


def test_ids_are_the_library_s_and_decode_to_the_text(spark, library):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).repartition(3)
    got = B.decode(B.encode(docs)).collect()
    expected = sorted((-1 if i is None else i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in got) == expected


def test_long_texts_are_cut_where_no_pre_token_ends_elsewhere(monkeypatch, tokens, library):
    monkeypatch.setattr(B, "PIECE", 7)
    c = B.Coder(tokens, B.PerfectHash(tokens), B.pattern())
    for t in texts(9):
        assert c.encode(t or "").tolist() == library.encode_ordinary(t or "")
        assert "".join(c.cuts(t or "")) == (t or "")


def test_a_small_cache_changes_nothing(monkeypatch, tokens, library):
    monkeypatch.setattr(B, "CACHE", 3)
    c = B.Coder(tokens, B.PerfectHash(tokens), B.pattern())
    assert [c.encode(t or "").tolist() for t in texts(4)] == [library.encode_ordinary(t or "") for t in texts(4)]


def test_ids_that_are_none_decode_to_null(spark):
    rows = [(1, [0, 1]), (2, None), (3, [0, None]), (4, [99999999]), (5, []), (6, [-1]), (7, [50255])]
    got = {r.doc_id: r.decoded for r in B.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>")).collect()}
    assert bytes(got[1]) == b'!"' and bytes(got[5]) == b"" and got[7] is not None
    assert got[2] is got[3] is got[4] is got[6] is None


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts(11))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op13_bytebpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert B.op13_bytebpe(spark, str(tmp_path / "none")).collect() == []
