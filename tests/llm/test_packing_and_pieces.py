"""Packing and sentencepiece against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers

from locuskit.llm import packing, pieces

WORDS, MODEL = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["The", "naïve", "word", "İstanbul", "é", "日本", "don't", "123", "²", "x" * 60, "\x1c", " ", "<|endoftext|>", "▁", "  ", "\n", "🙂", "...", "A_b", "​", "ﬁ"]


def corpus(n=120):
    r = random.Random(7)
    return [(i, "".join(r.choice(BITS) + r.choice(["", " ", "  "]) for _ in range(r.choice([0, 1, 5, 40])))) for i in range(n)] + [(500, None), (500, ""), (None, "a b"), (501, "word " * 9000), (502, " lead"), (503, "trail "), (504, "▁")]


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    got = packing.pack(df, WORDS).collect()
    assert {len(x.ids) // 4 for x in got} <= {1 << b for b in range(13)}
    assert len({x.sequence_id for x in got}) == len(got) and all(x.offset == 0 and x.length == 1 << x.bucket == len(x.ids) // 4 for x in got)
    for i, t in rows:
        want = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        own = sorted((x.start, x.ids) for x in got if x.id == i and x.doc_tokens == len(want) // 4)
        if i not in (500, None):
            assert b"".join(bytes(b) for _, b in own) == want, repr(t)
    d = packing.digest(packing.pack(df.filter("doc_id = 501"), WORDS)).collect()
    assert {x.ids_crc32 for x in d} == {zlib.crc32(bytes(x.ids)) for x in got if x.id == 501}
    assert packing.pack(df.limit(0), WORDS).collect() == []
    assert packing.lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]


def test_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, decoded string")
    got = sorted(((x.id, tuple(x.ids), x.decoded) for x in pieces.encode_decode(df, MODEL).collect()), key=str)
    want = sorted(((i, tuple(ids := [*lib.encode(t or ""), lib.eos_id()]), lib.decode(ids)) for i, t in rows), key=str)
    assert got == want
    assert pieces.encode_decode(df.limit(0), MODEL).collect() == []


def test_agenda_alone_equals_the_library():
    codec = pieces.PieceEncoder(MODEL)
    r = random.Random(3)
    for _ in range(300):
        chunk = "▁" + "".join(r.choices("thenigas日é🙂1", k=r.randint(1, 70)))
        assert codec.merge(chunk) == codec.library.encode(chunk[1:])


def test_digests(spark):
    got = {r.doc_id: r for r in pieces.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    codec = pieces.PieceEncoder(MODEL)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect():
        ids = [*codec.library.encode(r.text or ""), 2]
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
