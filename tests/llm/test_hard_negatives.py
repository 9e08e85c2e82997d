"""Hard negatives against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locuskit.llm import hard_negatives as hn


def plain(rows, every, k=5, m=3):
    fine = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, c in fine:
        if i % every:
            continue
        near = sorted((-score(v, w), j) for j, w, d in fine if d == c and j != i)[:k]
        far = sorted((-score(v, w), j) for j, w, d in fine if d != c)
        for p, j in near:
            fit = [(-s, n) for s, n in far if -50 * p <= -100 * s <= -95 * p][:m]
            out += [(i, j, at, n, -p, s) for at, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, embedding array<float>, label int, n2 double, part string")
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def drawn(seed, n, size=6, labels=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        f = r.choice([0.2, 1, 1, 5])
        rows.append((i, [f * r.gauss(0.3, 1) for _ in range(size)], r.randrange(labels)))
    return rows


def test_against_loops(spark, monkeypatch):
    rows = drawn(1, 400)
    same = [0.5, 0.25, -0.5, 1.0, 0.0, 0.125]
    rows += [(1000 + i, same, i % 3) for i in range(120)]  # many ties
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(10, same, 2)]  # repeated rows, and one id with two vectors
    rows += [(None, same, 1), (2000, None, 1), (2010, [None, 1.0], 1), (2020, [math.nan], 1), (2030, [math.inf], 1), (2040, same, None), (2050, [], 1), (2060, [0.0] * 6, 1), (2070, [2.0, 3.0], 2)]
    want = plain(rows, 10)
    assert len(want) > 300 and mined(spark, rows, 10) == want
    monkeypatch.setattr(hn, "PART", (40, 40))
    monkeypatch.setattr(hn, "WAVE", 3)
    monkeypatch.setattr(hn, "STREAM", 17)
    assert mined(spark, rows, 10) == want


def test_pruning_keeps_results(monkeypatch):
    """A bucket is left out only when no row of it can matter: the same rows with tiny and with huge buckets."""
    import numpy as np
    import pyarrow as pa

    rows = sorted(((i, [float(math.floor(256 * x)) for x in v], str(c)) for i, v, c in drawn(4, 300)), key=lambda x: -sum(y * y for y in x[1]))
    window = pa.list_(pa.struct([("w", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("need", pa.float64())]))
    schema = pa.schema([("part", pa.int32()), ("copy", pa.int32()), ("kind", pa.int32()), ("r", pa.int64()), ("id", pa.int64()), ("label", pa.string()), ("n2", pa.float64()), ("vec", pa.list_(pa.float64())), ("windows", window)])
    line = lambda kind, i, v, c, w=None: {"part": 0, "copy": 0, "kind": kind, "r": i, "id": i, "label": c, "n2": sum(x * x for x in v), "vec": v, "windows": w}
    ask = lambda v: [{"w": 1, "low": 0.0, "high": 0.4 * sum(x * x for x in v), "need": 0.0}, {"w": 2, "low": 0.3 * sum(x * x for x in v), "high": math.inf, "need": 0.0}]
    table = pa.Table.from_pylist([line(0, *r) for r in rows] + [line(1, *r, ask(r[1])) for r in rows[::7]], schema)
    found, work = {}, {}
    for bucket in (1, 16, 10_000):
        monkeypatch.setattr(hn, "BUCKET", bucket)
        calls = []
        monkeypatch.setattr(np, "partition", lambda a, *x, f=np.partition, **y: calls.append(a.size) or f(a, *x, **y))
        found[bucket] = sorted(tuple(x.values()) for b in hn._search(iter(table.to_batches(max_chunksize=50)), False, 3) for x in b.to_pylist())
        work[bucket] = sum(calls)
        monkeypatch.undo()
    assert found[1] == found[16] == found[10_000] and found[1]
    assert work[16] < work[10_000] / 2


def test_empty_and_lone(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(0, None, 1)], 10) == []
    assert mined(spark, [(0, [1.0], 1)], 10) == [] == mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 10)
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], 10) == [(0, 1, 1, 2, 65536, 58880)]
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)], 10) == []


def test_large_norms(spark):
    with pytest.raises(ValueError, match="53 bits"):
        mined(spark, [(0, [3e12], 1), (1, [1.0], 1)], 10)
