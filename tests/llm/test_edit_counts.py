"""Edit-aware counts against encoding the whole edited text."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locuskit.llm import edit_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", "the", " ", "  ", "\n", "   \t", "'", "'ll", "'s", "é", "日本", "12", "3", "!?", "x" * 30, " word", "I've", " ", "🙂"]


@pytest.mark.parametrize("seed", range(30))
def test_tree_counts_equal_whole_encoding(seed):
    r, codec = random.Random(seed), edit_counts.Counter(PATH)
    text = "".join(r.choices(BITS, k=r.choice([0, 1, 5, 100, 3000])))
    pieces = codec.cut(text)
    tree = edit_counts.TokenTree(list(map(len, pieces)), codec.count(pieces))
    for _ in range(40):
        n = len(text)
        a = r.choice([0, n, r.randint(0, n)])
        b = min(n, a + r.choice([0, 1, 2, 10, 200]))
        new = "".join(r.choices(BITS, k=r.choice([0, 0, 1, 3, 60])))
        text, want = tree.edit(text, a, b, new, codec), text[:a] + new + text[b:]
        assert text == want
        assert sum(tree.pieces()[0]) == len(text) == tree.chars[1]
        assert tree.total == len(codec.library.encode_ordinary(text)) == sum(tree.pieces()[1])
        assert tree.pieces()[0] == list(map(len, codec.cut(text)))


def test_edits_touch_little():
    codec = edit_counts.Counter(PATH)
    text = "some words of a long text, " * 4000
    pieces = codec.cut(text)
    tree = edit_counts.TokenTree(list(map(len, pieces)), codec.count(pieces))
    codec.encoded_chars = 0
    tree.edit(text, 50_000, 50_004, "other", codec)
    assert codec.encoded_chars < 60


def test_table(spark):
    rows = [(1, "Some text, it's here."), (1, None), (None, ""), (4, "x" * 50_000 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    edits = edit_counts.drawn_edits(F.col("doc_id"), F.col("text"))
    first = edit_counts.count_edited(df, PATH, edits, trees=True)
    codec = edit_counts.Counter(PATH)
    for r in first.collect():
        assert r.n_tokens_edited == len(codec.library.encode_ordinary(r.text)) and r.n_edits == 3
    again = edit_counts.count_edited(first, PATH, F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit(" new").alias("new")), F.lit(None)), id_col="id", trees=True, saved=True).collect()
    assert sorted(r.n_tokens for r in again) == sorted(r.n_tokens_edited for r in first.collect())
    for r in again:
        assert r.n_tokens_edited == len(codec.library.encode_ordinary(r.text)) and r.n_edits == 1
    table = spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 0, "a")], "doc_id long, seq int, start int, `end` int, new string")
    assert [e.new for e in edit_counts.gathered(table).first().edits] == ["a", "b"]
    assert edit_counts.count_edited(df.limit(0), PATH).collect() == []


def test_own_columns_named_like_trees(spark):
    df = spark.createDataFrame([(1, "one two three", [1], [900], 5)], "doc_id long, text string, lengths array<int>, tokens array<int>, id int")
    got = edit_counts.count_edited(df, PATH).first()
    assert got.n_tokens == len(edit_counts.Counter(PATH).library.encode_ordinary("one two three")) and got.id == 1
