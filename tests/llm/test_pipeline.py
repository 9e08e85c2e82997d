"""Every stage of the pipeline against brute force on a small corpus."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from locuskit.llm import pii, quality
from locuskit.llm.shared import leaving_nothing, table

from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]

    kept = {r.doc_id for r in stages["quality"](spark, docs, SF).collect()}
    trees = quality.train(docs, table(spark, SF, "labels"))
    assert kept == {i for i, r in rows.items() if trees.scores(quality.statistics([r.text or ""]))[0] >= 0.5}
    marked = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in marked.items()]) > 0.95

    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    out = stages["exact_dedup"](spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == set(first.values())

    out = stages["near_dedup"](spark, docs, SF)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {i for i, _, c in brute([(i, r.text) for i, r in rows.items()], 5, 80) if i == c}

    out = stages["pii"](spark, docs, SF)
    assert out.columns == columns
    for r in out.collect():
        spans = pii.base_spans(rows[r.doc_id].text or "")
        assert not pii.base_spans(r.text or "") or spans == [] or all(s not in r.text for s in {rows[r.doc_id].text[a:b] for _, a, b in spans})
        assert r.text == rows[r.doc_id].text or spans
        assert r.text is None or r.n_chars == len(r.text) or r.text == rows[r.doc_id].text

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stages["packing"](spark, docs, SF).collect()
    total = {i: len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in rows.items()}
    assert {i: sum(x.length for x in got if x.doc_id == i) for i in rows} == total


def test_run(spark):
    """What each stage leaves of all that the one before left, by plain code, down to the tokens of every document."""
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = table(spark, SF, "documents")
    trees = quality.train(docs, table(spark, SF, "labels"))
    left = {r.doc_id: r.text for r in docs.collect() if trees.scores(quality.statistics([r.text or ""]))[0] >= 0.5}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, _, c in brute(list(left.items()), 5, 80) if i == c}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(i, t, len(t or "")) for i, t in left.items()], "doc_id long, text string, n_chars long")).collect()}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, held = {}, {}
    for x in got.collect():
        pieces.setdefault(x.doc_id, []).append((x.start, x.length, x.doc_tokens))
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(pieces) == set(clean) and len(clean) > 20
    for i, t in clean.items():
        n, at = len(whole.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for start, length, tokens in sorted(pieces[i]):
            assert start == at and tokens == n
            at += length
        assert at == n
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_odd_tables(spark):
    """Null ids and texts, repeated ids, ties, a very long text and columns named like helpers pass each stage by its rule."""
    long = "+1 (555) 010-2030 " + " ".join(f"w{i % 9973}" for i in range(120_000))
    rows = [
        (None, None, None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "x@y.zz and +1 (555) 010-2030", "en", "s", 29), (7, long, "en", "s", len(long)), (5, long, "en", "s", len(long)), (6, long + " end", "en", "s", len(long) + 4),
        (9, "one two three four five six", "en", "s", 27), (8, "ONE two three four five  six", "en", "s", 28),
    ]
    extra = ("id", "row", "key", "extra", "gram", "comp", "__key", "__dropped", "keep_id", "size", "text_sha256")
    schema = table(spark, SF, "documents").schema
    odd = spark.createDataFrame(rows, schema)
    for c in extra:
        odd = odd.withColumn(c, odd["doc_id"] * 0 + 4)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, spark.createDataFrame([], odd.schema), SF).collect() == [], name
    trees = quality.train(odd, table(spark, SF, "labels"))
    good = [trees.scores(quality.statistics([r[1] or ""]))[0] >= 0.5 for r in rows]
    out = stages["quality"](spark, odd, SF)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r, g in zip(rows, good, strict=True) if g)
    out = stages["exact_dedup"](spark, odd, SF)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 6, 8, 9]
    out = stages["near_dedup"](spark, odd, SF)
    # The null id stays; 1 is there twice; 5, 6 and 7 are one group; 8 and 9 share both of their grams.
    assert out.columns == odd.columns and sorted((r.doc_id for r in out.collect()), key=lambda i: (i is not None, i)) == [None, 1, 1, 2, 5, 8]
    out = stages["pii"](spark, odd, SF)
    got = out.collect()
    assert out.columns == odd.columns and len(got) == len(rows) and {r[c] for r in got for c in extra if r.doc_id} == {4}
    assert {r.text for r in got if r.doc_id == 2} == {"[EMAIL] and [PHONE]"} and {r.text[:9] for r in got if r.doc_id in (5, 6, 7)} == {"[PHONE] w"}
    pieces = stages["packing"](spark, odd, SF)
    assert {r.doc_id for r in pieces.collect()} == {r[0] for r in rows} and pieces.filter("doc_id = 1").count() == 2


def test_workers_keep_nothing_of_a_stage(spark):
    """A worker that encoded, hashed or packed texts has neither words nor tokenizer afterwards."""

    def held(batches):
        import pyarrow as pa

        from locuskit.llm import ngram_join, packing

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([packing.encoder.cache_info().currsize]), pa.array([len(ngram_join._word_hashes())])], names=["encoders", "words"])

    docs, probe = table(spark, SF, "documents"), spark.range(64).repartition(16)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_dedup", "packing"):
        stages[name](spark, docs, SF).count()
        assert {tuple(r) for r in probe.mapInArrow(held, "encoders long, words long").collect()} == {(0, 0)}


def test_what_is_remembered_goes_with_the_task():
    dropped = []

    def run(batches):
        for b in batches:
            yield b
            if b == 2:
                raise ValueError("as a task fails")

    got = leaving_nothing(run, lambda: dropped.append(1))
    assert list(got([0, 1])) == [0, 1] and dropped == [1]
    seen = []
    try:
        seen.extend(got([1, 2, 3]))
    except ValueError:
        seen.append("failed")
    assert seen == [1, 2, "failed"] and dropped == [1, 1]
