"""The classifier on held-out labels, and its parts against plain code."""

import math

import numpy as np

from locuskit.llm import quality


def auc(p, y):
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    y = held.quality.to_numpy()
    assert auc(held.score.to_numpy(), y) > 0.99 and (held.predicted == y).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_trees_walk_like_plain_code():
    g = np.random.default_rng(1)
    x = g.standard_normal((500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    t = quality.fit(x, y, trees=20, depth=3)
    assert ((t.scores(x) >= 0.5) == y).mean() > 0.9

    def one(row):
        total = t.base
        for f, c, v in zip(t.feature, t.cut, t.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.scores(x[:50]), [one(r) for r in x[:50]])
    assert np.array_equal(quality.fit(x, y, trees=5).leaf, quality.fit(x, y, trees=5).leaf)


def test_odd_rows(spark):
    texts = ["", " ", "\n\n", "é" * 10, "a" * 200_000, "日本 語"]
    assert np.isfinite(quality.statistics(texts)).all()
    assert 0 < quality.fit(np.zeros((0, len(quality.STATISTICS))), []).scores(quality.statistics(texts))[0] < 1
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (3, "some text", "z"), (3, "some text", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (1, None, 0), (1, 5, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(df, labels)
    assert quality.score(df, trees).count() == 4
    assert quality.keep_good(df, trees, threshold=0.0).columns == df.columns and quality.keep_good(df, trees, threshold=0.0).count() == 4
    assert quality.score(df.limit(0), trees).collect() == []


def plain_tree(x, y, total, depth, bins, rate, ridge, least):
    """One tree by trying every cut of every column for each node, row by row."""
    p = [1 / (1 + math.exp(-t)) for t in total]
    g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
    cuts = [sorted({sorted(c)[math.floor((len(c) - 1) * q / bins)] for q in range(1, bins)}) for c in x.T.tolist()]
    made, rows_of, leaf = {}, {0: list(range(len(y)))}, {}
    for node in range(2**depth - 1):
        rows, best = rows_of[node], (1e-9, 0, math.inf)
        whole = sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + ridge)
        for f, column in enumerate(cuts):
            for c in column:
                low = [i for i in rows if x[i, f] <= c]
                high = [i for i in rows if x[i, f] > c]
                hl, hh = sum(h[i] for i in low), sum(h[i] for i in high)
                if hl >= least / 4 and hh >= least / 4:
                    gain = sum(g[i] for i in low) ** 2 / (hl + ridge) + sum(g[i] for i in high) ** 2 / (hh + ridge) - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, f, c)
        made[node] = best[1:]
        rows_of[2 * node + 1] = [i for i in rows if x[i, best[1]] <= best[2]]
        rows_of[2 * node + 2] = [i for i in rows if x[i, best[1]] > best[2]]
    for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
        value = -rate * sum(g[i] for i in rows_of[node]) / (sum(h[i] for i in rows_of[node]) + ridge)
        leaf[node] = value
        for i in rows_of[node]:
            total[i] += value
    return made, leaf


def test_trees_equal_a_plain_search():
    g = np.random.default_rng(8)
    x = np.round(g.standard_normal((160, 4)), 2)
    y = ((x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + 0.3 * g.standard_normal(160)) > 0).astype(int)
    settings = {"depth": 3, "bins": 16, "rate": 0.3, "ridge": 2.0, "least": 8.0}
    trees = quality.fit(x, y, trees=4, **settings)
    total = [trees.base] * len(y)
    assert math.isclose(trees.base, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        made, values = plain_tree(x, y.tolist(), total, **settings)
        assert [(int(f), float(c)) for f, c in zip(feature, cut, strict=True)] == [made[n] for n in range(7)]
        assert np.allclose(leaf, [values[n] for n in range(7, 15)], atol=1e-12)
    assert np.allclose(trees.scores(x), 1 / (1 + np.exp(-np.array(total))), atol=1e-12)


def test_statistics_equal_plain_counts():
    texts = ["", " ", "One line. Two, three!", "a a a\na a a\n\nB" + "x" * 40, "Ünïcode: 12 items | 3-4 'quoted'\t#tag", "UPPER lower 7up (x) [y] {z}\x07"]
    got = quality.statistics(texts)
    for text, row in zip(texts, got, strict=True):
        s, raw, words, lines = dict(zip(quality.STATISTICS, row, strict=True)), text.encode(), text.split(), text.split("\n")
        n, w = max(1, len(raw)), max(1, len(words))
        of = lambda chars, raw=raw, n=n: sum(b in chars for b in raw) / n
        want = {
            "log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)), "distinct_words": len(set(words)) / w, "top_word": max((words.count(x) for x in words), default=0) / w, "distinct_lines": len(set(lines)) / len(lines),
            "upper": of(range(65, 91)), "digits": of(b"0123456789"), "spaces": of(b" \t"), "stops": of(b".?!"), "commas": of(b",;:"), "bars": of(b"|"), "dashes": of(b"-"), "high_bytes": of(range(128, 256)), "long_words": sum(len(x) > quality.LONG_WORD for x in words) / w,
            "sentence_ends": sum(x[-1] in ".?!" for x in words) / w, "upper_words": sum(len(x) > 1 and x.isupper() for x in words) / w, "capital_words": sum(x[0].isupper() for x in words) / w, "number_words": sum(x[0].isdigit() for x in words) / w,
            "log_longest_word": math.log1p(max(map(len, words), default=0)), "distinct_chars": len(set(raw)) / 256, "controls": of([*range(9), *range(14, 32), 127]), "brackets": of(b"()[]{}<>"),
        }
        assert {k: round(float(s[k]), 12) for k in want} == {k: round(v, 12) for k, v in want.items()}, text
