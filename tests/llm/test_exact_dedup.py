"""Exact duplicates against plain grouping."""

import hashlib
import random
import re

from locuskit.llm import exact_dedup


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = set()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    return out


def test_matches_plain_grouping(spark):
    r = random.Random(1)
    texts = ["", None, " ", "a b", "a  b", "a\tb", "é", "x" * 200 + "1", "x" * 200 + "2", "y" * 100_000] + [f"t{i}" for i in range(50)]
    rows = [(i, r.choice(texts)) for i in r.sample(range(5000), 400)] + [(6000 + i, "hot text") for i in range(300)] + [(None, "a b"), (None, "only null")]
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, part string, run int").repartition(7)
    got = exact_dedup.mark_duplicates(df).collect()
    assert {(x.id, x.keep_id, x.group_size, x.text_sha256) for x in got} == plain(rows) and len(got) == len(rows)
    kept = {(x.id, x.text_sha256) for x in got if x.kept}
    assert kept == {(k, h) for _, k, _, h in plain(rows)} and sum(x.kept for x in got) == len(kept)
    rest = exact_dedup.keep_first(df)
    assert rest.columns == df.columns and {x.doc_id for x in rest.collect()} == {i for i, _ in kept}


def test_rows_that_repeat_whole(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(None, "a")], "doc_id long, text string")
    assert sum(x.kept for x in exact_dedup.mark_duplicates(df).collect()) == 1
    assert exact_dedup.keep_first(df).count() == 1
    assert exact_dedup.mark_duplicates(df.limit(0)).collect() == [] and exact_dedup.keep_first(df.limit(0)).collect() == []
