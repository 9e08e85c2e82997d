"""Gene numbers dealt in parallel against the rule worked off in a plain loop."""

import random
from functools import reduce
from math import gcd

import pytest
from pyspark.sql import functions as F

from locuskit.operators import allocation, islands
from tests.test_operators import rows

NEW = "new_id string, seqid string, start long, `end` long"
CURRENT = "seqid string, start long, gene_id string"


def plain_gap(low, high, width, step, count, used):
    if high is None:
        out, at = [], low
        for _ in range(count):
            at += step
            while at in used and at < 10**width:
                at += 10
            if at >= 10**width:
                return None
            out.append(at)
        return out
    if low is not None and not low < high <= low + 1_000_000:
        return None
    low = low or 0
    free, out = set(range(low + 1, high)) - used, []
    if len(free) < count:
        return None
    for i in range(1, count + 1):
        target = low + (high - low) * i / (count + 1)
        best = next(c for m in (10, 5, 1) if (c := [n for n in free if n % m == 0]))
        n = min(best, key=lambda n: (abs(n - target), n))
        free.remove(n)
        out.append(n)
    return out


def plain_positions(new, current, reserved):
    """One gap after the other; identifiers are a letter and digits."""
    part = lambda g: (p := g.rstrip("0123456789"), int(g[len(p) :]), len(g) - len(p))
    used = {}
    for g in [*reserved, *(g for _, _, g in current)]:
        used.setdefault(part(g)[0], set()).add(part(g)[1])
    gaps = {}
    for i, s, a, b in new:
        anchors = sorted((at, *part(g)[1::-1], g, part(g)[2]) for q, at, g in current if q == s)
        k = sum(x[0] <= a for x in anchors)
        if anchors:
            gaps.setdefault((s, k - 1), []).append((a, b, i))
    out = {}
    for (s, k), genes in sorted(gaps.items()):
        anchors = sorted((at, *part(g)[1::-1], g, part(g)[2]) for q, at, g in current if q == s)
        l, r = anchors[k] if k >= 0 else None, anchors[k + 1] if k + 1 < len(anchors) else None
        name, width = (l or r)[2], (l or r)[4]
        own = [x for x in anchors if x[2] == name]
        near = list(zip(own, own[1:]))
        if len(near) < 2 or sum(b[1] > a[1] for a, b in near) < 0.98 * len(near) or any(x and x[2] != name for x in (l, r)):
            continue
        numbers = sorted(x[1] for x in own)
        d = sorted(b - a for a, b in zip(numbers, numbers[1:]) if b > a)
        got = plain_gap(l and l[1], r and r[1], width, d[len(d) // 2] if d else 100, len(genes), used[name])
        if got:
            used[name].update(got)
            out |= {i: f"{name}{n:0{width}d}" for (_, _, i), n in zip(sorted(genes), got)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_positions(spark, monkeypatch, seed):
    """Sequences share a name space whose ranges overlap, so gaps want the same numbers; little is known of taken ones at first."""
    monkeypatch.setattr(allocation, "REACH", [1, 2, 64][seed % 3])
    monkeypatch.setattr(allocation, "FURTHER", 2)
    r = random.Random(seed)
    current, reserved = [], set()
    for s in "abcdef":
        number = r.randint(1, 60)
        for k in range(r.randint(3, 14)):
            number += r.choice([1, 3, 10, 10, 50])
            current.append((s, 100 * k + r.randint(0, 50), f"{'AG' if seed < 2 or s < 'd' else 'BG'}{number:03d}"))
    reserved = {f"AG{r.choice([r.randint(0, 300), 10 * r.randint(0, 40)]):03d}" for _ in range(r.choice([0, 40, 250]))}
    new = [(f"n{i}", r.choice("abcdefg"), a := r.randint(0, 1500), a + 10) for i in range(60)]
    want = plain_positions(new, current, reserved)
    given = rows(spark, [(g,) for g in {*reserved, *(g for _, _, g in current)}], "gene_id string")
    got = {x.new_id: x.gene_id for x in allocation.positional_ids(rows(spark, new, NEW), rows(spark, current, CURRENT), given).collect()}
    assert got == want and len(set(got.values())) == len(got)


def test_query_equals_plain_loop(spark):
    """g09 over whole tables: one name space holds five sequences, so heads and tails of one lie among the numbers of others."""
    from locuskit.catalog import QUERIES
    from locuskit.plans.views import transcripts

    sf = "/root/testdata/sf0.001"
    t = transcripts(spark, sf).select("tx_id", "seqid", "source", "start", "end").collect()
    current = [(x.seqid, x.start, f"GeneG{10 * x.tx_id:09d}") for x in t if x.source == "current"]
    new = [(str(x.tx_id), x.seqid, x.start, x.end) for x in t if x.source == "ToolA"]
    want = plain_positions(new, current, [])
    assert len(want) > 300 and {x.new_id: x.gene_id for x in QUERIES["g09_positional_ids"](spark, sf).collect()} == want


def test_known_runs_say_enough():
    """A gap that knows runs in narrow windows gives the numbers of one that knows all, or asks for more."""
    r, asked = random.Random(8), 0
    for _ in range(2000):
        low, count = r.randint(0, 50), r.randint(1, 5)
        gap = {"low": low, "high": r.choice([None, low + r.randint(1, 300)]), "width": 3, "step": r.randint(1, 20)}
        numbers = {r.choice([r.randint(0, 400), 10 * r.randint(0, 40)]) for _ in range(r.choice([0, 30, 300]))}
        whole = allocation.Taken.of(numbers)
        reach, high = r.randint(1, 20), gap["high"]
        windows = [(low, low + count * gap["step"] + reach)] if high is None else [(max(low, t - reach), min(high, t + reach)) for i in range(1, count + 1) for t in [int(low + (high - low) * i / (count + 1))]]
        seen = {m: [(a, b) for a, b in zip(whole.first[m], whole.last[m]) if any(a <= y and x <= b for x, y in windows)] for m in allocation.ROUND}
        want = plain_gap(gap["low"], high, 3, gap["step"], count, set(numbers))
        try:
            assert allocation.gap_numbers(gap, count, allocation.Taken(seen, windows)) == want
        except allocation.Unknown:
            asked += 1
        assert allocation.gap_numbers(gap, count, set(numbers)) == want
    assert 100 < asked < 1500


def test_dense_name_space(spark):
    """All multiples of ten up to 20,000 are taken: the gap before the first gene finds a five without seeing them one by one."""
    current = [("a", k, f"AG{10 * k:06d}") for k in range(1, 1001)] + [("b", k, f"AG{10 * k + 10_000:06d}") for k in range(1, 1001)]
    given = rows(spark, [(g,) for _, _, g in current], "gene_id string")
    got = allocation.positional_ids(rows(spark, [("x", "b", 0, 0), ("y", "b", 0, 1), ("z", "a", 5000, 5001)], NEW), rows(spark, current, CURRENT), given)
    assert {x.new_id: x.gene_id for x in got.collect()} == {"x": "AG003335", "y": "AG006675", "z": "AG020010"}


def test_refusals(spark):
    current = rows(spark, [("a", 10, "AG000010"), ("a", 20, "AG000011"), ("a", 30, "AG000012"), ("b", 5, "AG000100")], CURRENT)
    new, none = rows(spark, [("p", "a", 15, 16)], NEW), rows(spark, [], "new_id string, gene_id string, basis string, status string")
    ids = rows(spark, [], "gene_id string")
    with pytest.raises(ValueError, match="no number between the current ones for p"):
        allocation.gene_mapping(new, none, current, ids, strategy="current_style_positional")
    (x,) = allocation.gene_mapping(new, none, current, ids, prefix="QG", strategy="current_style_positional", refuse=False).collect()
    assert (x.gene_id, x.basis, x.collides) == ("QG00000001", "sequential_new_namespace", False)
    same = rows(spark, [("p", "AG000010", "b", "s"), ("q", "AG000010", "b", "s")], "new_id string, gene_id string, basis string, status string")
    with pytest.raises(ValueError, match="given twice: . AG000010|given twice: p: AG000010|given twice: q: AG000010"):
        allocation.gene_mapping(new, same, current, ids)
    assert all(x.collides for x in allocation.gene_mapping(rows(spark, [], NEW), same, current, ids, refuse=False).collect())


def test_styles(spark):
    """Of equally common styles the one met first; numbers pass over those that exist and end with the width."""
    current = rows(spark, [(0, "s", "BG010"), (1, "s", "AG020"), (2, "s", "AG960"), (3, "s", "BG020")], "row_idx long, seqid string, gene_id string")
    new = rows(spark, [(f"n{i}", "s", i) for i in range(5)], "new_id string, seqid string, start long")
    given = rows(spark, [("BG040",), ("BG050",)], "gene_id string")
    got = {x.new_id: x.gene_id for x in allocation.style_ids(new, current, given).collect()}
    assert got == {"n0": "BG030", "n1": "BG060", "n2": "BG070", "n3": "BG080", "n4": "BG090"}
    full = allocation.style_ids(new, rows(spark, [("s", "AG989"), ("s", "AG993")], "seqid string, gene_id string"), given)
    assert {x.new_id: x.gene_id for x in full.collect()} == {"n0": "AG997"}


def test_free_ranks(spark, monkeypatch):
    monkeypatch.setattr(islands, "BIN", 8)
    r = random.Random(3)
    taken = {(k, r.randint(0, 60)) for k in "ab" for _ in range(40)}
    asked = [(k, i) for k in "abc" for i in range(40)]
    got = allocation.free_ranks(rows(spark, asked, "key string, k long"), rows(spark, [*taken, *list(taken)[:5]], "key string, place long"), ["key"])
    for key in "abc":
        free = [n for n in range(200) if (key, n) not in taken]
        assert [x.place for x in sorted((x for x in got.collect() if x.key == key), key=lambda x: x.k)] == free[:40]


def test_islands_in_bins(spark):
    """Interval union, running sums, the row before, medians and steps over many bins against plain loops."""
    r = random.Random(5)
    given = [(k, s, s + r.choice([0, 2, 5, 90])) for k in "aab" for s in (r.randint(0, 700) for _ in range(90))] + [("c", 5, 900)] * 3 + [("d", None, 5), ("d", 5, None)]
    df = rows(spark, given, "k string, start long, `end` long")
    for gap in (0, 1, 7):
        want = []
        for k in "abc":
            now = None
            for s, e in sorted((s, e) for q, s, e in given if q == k):
                if now and s <= now[2] + gap:
                    now[2], now[3] = max(now[2], e), now[3] + 1
                else:
                    want.append(now := [k, s, e, 1])
        assert sorted(map(list, islands.merge_intervals(df, ["k"], gap, width=16).collect())) == sorted(want)
    line = rows(spark, [(k, i * 3, r.randint(-5, 9)) for k in "ab" for i in range(80)], "k string, at long, v long")
    seen = sorted(map(tuple, line.collect()))
    want = [(k, at, v, sum(w for q, b, w in seen if q == k and b < at), sum(q == k and b < at for q, b, _ in seen)) for k, at, v in seen]
    assert sorted(map(tuple, islands.running(line, ["k"], "at", {"s": F.col("v"), "n": F.lit(1)}, width=16).collect())) == want
    before = {(k, at): w for (q, _, w), (k, at, _) in zip(seen, seen[1:]) if q == k}
    assert all(x.p == before.get((x.k, x.at)) for x in islands.lagged(line, ["k"], ["at"], "v", "p", width=16).collect())
    assert {x.k: x.m for x in islands.upper_median(line, ["k"], "v", "m").collect()} == {k: sorted(v for q, _, v in seen if q == k)[40] for k in "ab"}
    numbers = {"a": [12 + 18 * i for i in range(9000)] + [12 + 45], "b": [7], "c": [2, 2**62]}
    steps = islands.numeric_steps(rows(spark, [(k, n) for k in numbers for n in numbers[k]] + [("a", None), (None, 4), (None, 10)], "k string, n long"), ["k"], "n")
    assert {x.k: x.step for x in steps.collect()} == {k: reduce(gcd, (b - min(v) for b in v)) or 1 for k, v in {**numbers, None: [4, 10]}.items()}


def test_look_back_of_one_row(spark):
    r = random.Random(6)
    index = [(i, r.choice("ab"), s := r.randint(0, 300), s + r.choice([3, 200])) for i in range(80)]
    asked = [(i, r.choice("abc"), s := r.randint(0, 300), s + 20) for i in range(40)]
    schema = "id int, seqid string, start long, `end` long"
    from locuskit.operators import range_join

    a, b = rows(spark, asked, schema), rows(spark, index, schema)
    got = {(x.id, x.id_r) for x in range_join.back_one_only(range_join.overlap_join(a, b, ["seqid"]), b, ["seqid"], "id").collect()}
    want = set()
    for i, q, s, e in asked:
        own = sorted((t, u, j) for j, p, t, u in index if p == q)
        begin = max(sum(t < s for t, _, _ in own) - 1, 0)
        want |= {(i, j) for t, u, j in own[begin:] if s <= u and t <= e}
    assert got == want
