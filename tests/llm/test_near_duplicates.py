"""Vector near duplicates and the n-gram join against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuskit.llm import ngram_join, vector_dedup


def reach(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_vectors_match_brute_force(spark):
    g = np.random.default_rng(3)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(60):
            base = g.standard_normal(24)
            for _ in range(int(g.integers(1, 6))):
                rows.append((i, [float(x) for x in base + g.standard_normal(24) * g.choice([0, 0.1, 0.25, 0.4])], label, "x"))
                i += 1
    rows += [(i, None, 1, "x"), (i + 1, [0.0] * 24, 1, "x"), (i + 2, [float("nan")] + [1.0] * 23, 1, "x"), (i + 3, [None] + [1.0] * 23, 1, "x"), (i + 4, [], 1, "x"), (i + 5, [1.0, 2.0], 1, "x"), (i + 6, [2.0, 4.0], 1, "x")]
    rows += [(None, rows[0][1], 1, "x"), (i + 7, rows[0][1], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    got = {(r.id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}

    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    use = [r for r in rows if fine(r)]
    links = []
    for x in range(len(use)):
        for y in range(x):
            if use[x][2] == use[y][2] and len(use[x][1]) == len(use[y][1]):
                u, v = np.array(use[x][1]), np.array(use[y][1])
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                    links.append((use[x][0], use[y][0]))
    comp = reach([r[0] for r in use], links)
    count = {r[0]: sum(r[0] in p for p in links) for r in use}
    want = {(i, count[i], c, c == i) for i, c in comp.items()} | {(r[0], 0, r[0], True) for r in rows if not fine(r)}
    assert got == want


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.near_duplicates(df).collect() == []


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    g = np.random.default_rng(5)
    base = g.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.01 * g.standard_normal(16)], 1) for i in range(100)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(99, 0)}


def test_vectors_are_fetched_only_for_near_sketches(spark, monkeypatch):
    """Rows without a near copy share buckets with others, but no vector of theirs is read again; ids may repeat."""
    kept = {}

    def watched(df, label, write=vector_dedup.stash_at):
        out = write(df, label)
        kept[label] = out[0]
        return out

    monkeypatch.setattr(vector_dedup, "stash_at", watched)
    monkeypatch.setattr(vector_dedup, "discard", lambda *_: None)
    g = np.random.default_rng(8)
    far = [(i, [float(x) for x in g.standard_normal(32)], 1) for i in range(600)]
    near = [(1000, far[7][1], 1), (1001, [1.01 * x + 0.01 for x in far[9][1]], 1), (9, [1.02 * x - 0.01 for x in far[9][1]], 1), (5, far[3][1][::-1], 1)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(far + near, "vec_id long, embedding array<float>, label int")).collect()
    linked = {(r.id, r.n_links, r.component_id) for r in got if r.n_links}
    assert linked == {(7, 1, 7), (1000, 1, 7), (9, 2, 9), (1001, 2, 9)} and sum(r.id == 9 for r in got) == 2
    spread = kept["hashed"].selectExpr("explode(codes)").count()
    assert 3 <= kept["members"].select("class").distinct().count() < 60 and kept["members"].count() < spread / 20
    assert "vec" not in kept["members"].columns


def test_sketches_of_linked_pairs_are_near():
    g = np.random.default_rng(2)
    planes, limit = g.standard_normal((48, vector_dedup.SKETCH)), vector_dedup.sketch_limit(0.93)
    x, y = g.standard_normal((2, 200_000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    apart = ((x @ planes > 0) != (near @ planes > 0)).sum(axis=1)
    assert apart.max() <= limit < vector_dedup.SKETCH / 2 - 10
    assert vector_dedup.sketch_limit(-1) >= vector_dedup.SKETCH


def brute(rows, size, percent):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()

    sets = [(i, grams(t)) for i, t in rows]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t)]
    comp = reach({i for i, _ in sets if i is not None}, links)
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = r.choices(vocabulary, k=60)
    rows = []
    for i in range(60):
        words = (common if r.random() < 0.4 else []) + r.choices(vocabulary, k=r.choice([1, 2, 3, 10, 60, 120]))
        for _ in range(r.choice([1, 1, 2, 6])):
            new = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w.upper() if r.random() < 0.1 else w for w in new) + r.choice(["", "\n", "\t "])))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "Ä b c"), (2004, "ä b c"), (None, rows[0][1]), (2005, "w1 " * 3000), (2006, "w1 w1 w1 w1 w1 w1")]


@pytest.mark.parametrize(("size", "percent", "block", "prunings"), [(3, 90, 2048, 2), (5, 80, 2048, 1), (3, 60, 4, 2), (3, 50, 7, 0)])
def test_join_matches_brute_force(spark, monkeypatch, size, percent, block, prunings):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PRUNINGS", prunings)
    rows = corpus(size * percent)
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, __dropped string, row int").withColumns({"id": F.lit(3), "gram": F.lit("g"), "comp": F.lit(1)})
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in ngram_join.similar(df, size, percent).collect()), key=str)
    assert got == brute(rows, size, percent)
    kept = ngram_join.keep_one(df, size, percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _, c in got if i is not None and i == c)


def test_bit_sets_never_differ_more_than_their_grams():
    g = np.random.default_rng(4)
    for n in (1, 3, 500, 513, 5000):
        common, more = g.integers(0, 2**63, n, dtype="u8"), g.integers(0, 2**63, n, dtype="u8")
        for k in (0, 1, n // 3, n):
            a, b = np.unique(common), np.unique(np.r_[common[k:], more[: k // 2]])
            if not len(b):
                continue
            x, y = (np.unpackbits(np.frombuffer(ngram_join.bit_set(s), "u1"), bitorder="little") for s in (a, b))
            m = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(s.reshape(-1, m), axis=0) for s in (x, y))
            assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_forest_is_a_least_spanning_forest():
    g = np.random.default_rng(6)
    for _ in range(30):
        rows, edges = int(g.integers(2, 40)), int(g.integers(1, 200))
        i, j, weight = g.integers(0, rows, edges), g.integers(0, rows, edges), g.permutation(edges).astype("u8")
        kept, root = [], list(range(rows))
        for e in np.argsort(weight):
            a, b = int(i[e]), int(j[e])
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[a] = b
                kept.append(int(e))
        assert sorted(ngram_join.forest(rows, i, j, weight).tolist()) == sorted(kept)


def test_join_ids_that_repeat_and_empty(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "e f g h"), (3, "e f g h"), (9, "a b c d")], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in ngram_join.similar(df, 3, 90).collect()} == {(5, 3), (3, 3), (9, 3)}
    assert ngram_join.similar(df.limit(0), 3, 90).collect() == []
