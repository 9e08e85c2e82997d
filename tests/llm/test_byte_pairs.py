"""Byte-level BPE by joined halves against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from locuskit.llm import byte_pairs

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["the", "ing", " a", "ä", "é", "日本", "\n", " ", "  ", "\t", "x", "12", "'s", "'LL", "!", "..", "🙂", "\x1c", "\x85", "aaaa", "Z", "naïve", "​", "<|endoftext|>", "0" * 9, " ", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_pairs.BytePairs(RANKS, P.PATTERN)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<i4").tolist()


def test_texts(codec, library):
    r = random.Random(5)
    for k in range(4000):
        text = "".join(r.choices(BITS, k=r.randint(0, 12 if k % 40 else 500)))
        got = ids(codec.encode(text))
        assert got == library.encode_ordinary(text), repr(text)
        assert codec.decode(got) == text.encode()


@pytest.mark.parametrize("unit", ["a", " ", "e ", "0", "é", "ab", "日"])
def test_long_runs(codec, library, unit):
    for n in (47, 48, 49, 1000, 30_000):
        assert ids(codec.encode(unit * n)) == library.encode_ordinary(unit * n)


def test_join_is_encoding_of_the_whole(codec):
    """Any cut of a byte string gives the same tokens, as does any order of joins; the empty list is neutral."""
    r = random.Random(9)
    for _ in range(1500):
        data = "".join(r.choices("abcdeeetttaaéщ日", k=r.randint(1, 60))).encode()
        whole = codec.merge(data)
        i, j = sorted((r.randint(0, len(data)), r.randint(0, len(data))))
        a, b, c = codec.merge(data[:i]), codec.merge(data[i:j]), codec.merge(data[j:])
        assert codec.join(codec.join(a, b), c) == codec.join(a, codec.join(b, c)) == whole == codec.reduced(data)
        assert codec.join(whole, []) == codec.join([], whole) == whole


def test_windows_equal_with_and_without_heap(codec, monkeypatch):
    r = random.Random(2)
    for _ in range(300):
        data = bytes(r.choices(b"aabet \xc3\xa9", k=r.randint(1, 80)))
        plain = codec._merge_long(data)
        monkeypatch.setattr(byte_pairs, "LONG_WINDOW", 10**9)
        assert codec.merge(data) == plain


def test_small_caches(library, monkeypatch):
    for name in ("CACHE_CHUNKS", "CACHE_PIECES", "CACHE_PAIRS", "CACHE_BYTES"):
        monkeypatch.setattr(byte_pairs, name, 5)
    monkeypatch.setattr(byte_pairs, "LEAF_CHARS", 20)
    monkeypatch.setattr(byte_pairs, "LEAF_IDS", 3)
    small, r = byte_pairs.BytePairs(RANKS, P.PATTERN), random.Random(4)
    for _ in range(300):
        text = "".join(r.choices(BITS, k=60))
        assert ids(small.encode(text)) == library.encode_ordinary(text)
        assert small.decode(ids(small.encode(text))) == text.encode()


def test_table(spark, library):
    r = random.Random(7)
    rows = [(i, "".join(r.choices(BITS, k=20))) for i in range(60)] + [(500, None), (500, ""), (None, "a b"), (501, "word " * 30_000), (501, "word " * 30_000), (502, " lead"), (503, "trail ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, decoded string, ids int")
    got = sorted(((x.id, tuple(x.ids), bytes(x.decoded)) for x in byte_pairs.encode_decode(df, RANKS).collect()), key=str)
    assert got == sorted(((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows), key=str)
    assert byte_pairs.encode_decode(df.limit(0), RANKS).collect() == []


def test_digests(spark, library):
    got = {r.doc_id: r for r in byte_pairs.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want, x = library.encode_ordinary(r.text or ""), got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_vocabulary_without_single_bytes(tmp_path):
    (tmp_path / "few").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_pairs.BytePairs(str(tmp_path / "few"), P.PATTERN)
