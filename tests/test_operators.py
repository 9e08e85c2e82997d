"""Core operators on small fixtures, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules, sequence, text
from locuskit.operators import components, evidence, islands, lineage, range_join


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("widen", [0, 7])
def test_overlap_join_finds_each_pair_once(spark, widen):
    r = random.Random(widen)
    span = lambda: r.choice([1, 5, 50, 5_000, 80_000, 2_000_000])
    make = lambda n: [(i, r.choice("ab"), s := r.randint(1, 3_000_000), s + span() - 1) for i in range(n)]
    a, b = make(120), make(150)
    schema = "id int, seqid string, start long, `end` long"
    got = sorted((x.id, x.id_r) for x in range_join.overlap_join(rows(spark, a, schema), rows(spark, b, schema), ["seqid"], widen).collect())
    want = sorted((i, j) for i, q, s, e in a for j, p, t, u in b if q == p and s - widen <= u and t <= e + widen)
    assert got == want


def test_one_row_look_back_loses_long_intervals(spark):
    schema = "id int, seqid string, start long, `end` long"
    index = rows(spark, [(1, "a", 1, 1000), (2, "a", 10, 20), (3, "a", 30, 40), (4, "a", 100, 120)], schema)
    query = rows(spark, [(9, "a", 105, 110)], schema)
    pairs = range_join.overlap_join(query, index, ["seqid"])
    assert sorted(x.id_r for x in pairs.collect()) == [1, 4]
    assert [x.id_r for x in range_join.back_one_only(pairs, index, ["seqid"], "id").collect()] == [4]


def test_components_and_descendants(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    nodes = sorted(set(range(200)) | {x for e in edges for x in e})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(rows(spark, [(n,) for n in nodes], "node long"), rows(spark, edges, "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == root
    tree = rows(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "b")], "parent string, child string")
    assert {x.node for x in components.descendants(tree, rows(spark, [("b",)], "node string")).collect()} == {"b", "c", "d"}


def test_merge_touching_and_as_of(spark):
    df = rows(spark, [("a", 1, 5), ("a", 6, 9), ("a", 3, 4), ("a", 11, 12), ("b", 1, 1)], "k string, start int, `end` int")
    assert sorted(tuple(x) for x in islands.merge_intervals(df, ["k"]).collect()) == [("a", 1, 9, 3), ("a", 11, 12, 1), ("b", 1, 1, 1)]
    anchors = rows(spark, [("a", 3, "p"), ("a", 11, "q")], "k string, start int, v string")
    seen = islands.as_of(df, anchors, ["k"], "start", "v")
    assert {(x.k, x.start): x.last_value for x in seen.collect()} == {("a", 1): None, ("a", 3): "p", ("a", 6): "p", ("a", 11): "q", ("b", 1): None}
    after = islands.as_of(df, anchors, ["k"], "start", "v", after=True)
    assert {(x.k, x.start): x.next_value for x in after.collect()} == {("a", 1): "p", ("a", 3): "q", ("a", 6): "q", ("a", 11): None, ("b", 1): None}


def test_block_functions(spark):
    df = rows(spark, [([(1, 3), (5, 6), (8, 9)], [(2, 5), (9, 20)], "+"), ([], [(1, 1)], "-")], "x array<struct<start:int,end:int>>, y array<struct<start:int,end:int>>, strand string")
    one, two = df.select(intervals.length(F.col("x")), intervals.shown(intervals.introns(F.col("x"))), intervals.set_overlap(F.col("x"), F.col("y")), intervals.shown(intervals.merged(F.col("x"))), intervals.jaccard(F.col("x"), F.col("y")), intervals.phases(F.col("x"), F.col("strand"))).collect()
    assert tuple(one) == (7, "4-4,7-7", 4, "1-3,5-6,8-9", 0.0, [0, 0, 1])
    assert tuple(two) == (0, "", 0, "", 0.0, [])


def test_text_functions(spark):
    df = rows(spark, [("ID=a;Parent=b,c;Note=x%20y;ID=z",), ('gene_id "g1"; transcript_id "t1";',), (None,)], "s string")
    pairs = text.attribute_pairs(F.col("s"))
    got = df.select(text.attribute(pairs, "ID", "transcript_id"), text.decoded(text.attribute(pairs, "Note")), F.size(pairs)).collect()
    assert [tuple(g) for g in got] == [("z", "x y", 4), ("t1", None, 2), (None, None, 0)]
    ids = rows(spark, [("LOC_Os01G0012300",), ("AB12x3456",), ("none",)], "s string").select(text.id_parts(F.col("s")).alias("p"), text.transcript_of(F.col("s"))).collect()
    assert (ids[0].p.prefix, ids[0].p.number, ids[0].p.width) == ("LOC_Os01G", 12300, 7) and ids[0][1] == "LOC_Os01T0012300"
    assert ids[1].p.number == 3456 and ids[2].p is None
    assert [x[0] for x in rows(spark, [("12.9",), ("x",), (None,)], "s string").select(text.whole_number(F.col("s"))).collect()] == [12, 0, 0]


def test_sequence_functions(spark):
    df = rows(spark, [("ATGTAAGGGTAG",), ("",), ("ATGCCCTGA",)], "s string")
    got = df.select(sequence.reverse_complement(F.col("s")), sequence.has_inner_stop(F.col("s")), sequence.ends_in_stop(F.col("s")), sequence.begins_with_start(F.col("s"))).collect()
    assert [tuple(g) for g in got] == [("CTACCCTTACAT", True, True, True), ("", False, False, False), ("TCAGGGCAT", False, True, True)]


def brute_assignment(scores, places=None):
    """All ways to give each gene of the smaller side a partner; of the best ones the first in order of genes."""
    places = places or {}
    olds, news = (sorted({p[k] for p in scores}, key=lambda g, s=side: (places.get((s, g), 0), g)) for k, side in enumerate(("old", "new")))
    few, many = (news, olds) if len(news) <= len(olds) else (olds, news)
    pair = lambda x, y: (y, x) if few is news else (x, y)
    ways = itertools.permutations(range(len(many)), len(few))
    sums = lambda w: tuple(-sum(x) for x in zip(*[scores.get(pair(few[i], many[j]), lineage.APART) for i, j in enumerate(w)], strict=True))
    best = min(ways, key=lambda w: (sums(w), w))
    return sorted(pair(few[i], many[j]) for i, j in enumerate(best))


@pytest.mark.parametrize("seed", range(60))
def test_assignment_equals_all_permutations(seed):
    r = random.Random(seed)
    scores = {(f"o{i}", f"n{j}"): tuple([*(r.randint(0, 2) for _ in range(4)), -r.randint(0, 3)]) for i in range(r.randint(1, 5)) for j in range(r.randint(1, 5)) if r.random() < 0.9}
    places = {(s, f"{s[0]}{i}"): r.randint(0, 3) for s in ("old", "new") for i in range(5)}
    if scores:
        assert lineage.best_pairs(scores, places) == brute_assignment(scores, places)


def test_nearest_free_equals_plain_search():
    r = random.Random(9)
    for _ in range(3000):
        low = r.randint(0, 40)
        high, taken = low + r.randint(1, 60), {r.randint(0, 110) for _ in range(r.randint(0, 90))}
        target = low + (high - low) * r.random()
        free = [n for n in range(low + 1, high) if n not in taken]
        want = next((min(c, key=lambda n: (abs(n - target), n)) for m in (10, 5, 1) if (c := [n for n in free if n % m == 0])), None)
        assert lineage.nearest_free(target, low, high, taken) == want


def test_gap_numbers():
    gap = lambda low, high, step=100, width=6: {"low": low, "high": high, "step": step, "width": width}
    assert lineage.gap_numbers(gap(100, 200), 1, set()) == [150]
    assert lineage.gap_numbers(gap(100, 200), 1, {150}) == [140]
    assert lineage.gap_numbers(gap(100, 102), 3, {101}) is None and lineage.gap_numbers(gap(200, 100), 1, set()) is None
    assert lineage.gap_numbers(gap(None, 100), 1, set()) == [50]
    assert lineage.gap_numbers(gap(100, None, 10), 3, {110}) == [120, 130, 140]
    assert lineage.gap_numbers(gap(999_990, None, 10), 1, set()) is None
    assert lineage.gap_numbers(gap(0, 2_000_000), 1, set()) is None


def test_junction_support_of_a_small_model(spark):
    """One intron 201-299 that eight reads of one sample support exactly."""
    seen = rows(spark, [("chr1", 201, 299, "+", "sample1", 8, 30), ("chr1", 600, 699, "+", "sample1", 5, 20)], "seqid string, start long, `end` long, strand string, sample string, reads long, hang long")
    introns = rows(spark, [("t1", "chr1", "+", 201, 299), ("t2", "chr1", "+", 202, 299), ("t3", "chr1", ".", 600, 699)], "tx string, seqid string, strand string, start long, `end` long")
    ok = evidence.supported(evidence.merged_junctions(seen))
    got = {x.tx: tuple(x)[1:] for x in evidence.model_support(introns, ok, ["tx"]).collect()}
    assert got == {"t1": (1, 1, True, True, True, ""), "t2": (1, 0, False, True, False, "202-299"), "t3": (1, 1, True, True, True, "")}
    near = evidence.listed_near(introns, ok, window=30).collect()
    assert {(x.tx, x.near) for x in near} == {("t2", "chr1:201-299:+")}


def test_islands_over_many_bins(spark):
    """As-of, fill and numbering in bins against plain loops, with places that lie far apart."""
    r = random.Random(3)
    anchors = sorted({(k, r.randint(0, 400)) for k in "ab" for _ in range(12)})
    rows_ = [(k, r.randint(0, 400), i) for i, k in enumerate(r.choices("abc", k=200))]
    df = rows(spark, rows_, "k string, start long, i long")
    a = rows(spark, [(k, s, f"{k}{s}") for k, s in anchors], "k string, start long, v string")
    two = islands.as_of(islands.as_of(df, a, ["k"], "start", "v", width=16), a, ["k"], "start", "v", after=True, width=16)
    for x in two.collect():
        before, after = [s for k, s in anchors if k == x.k and s <= x.start], [s for k, s in anchors if k == x.k and s > x.start]
        assert x.last_value == (f"{x.k}{max(before)}" if before else None) and x.next_value == (f"{x.k}{min(after)}" if after else None)
    some = rows(spark, [(k, i * 7, i if i % 9 == 4 else None) for k in "ab" for i in range(60)], "k string, start long, v long")
    for x in islands.forward_fill(some, ["k"], "start", "v", width=32).collect():
        n = x.start // 7
        assert x.v == (None if n < 4 else (n - 4) // 9 * 9 + 4)
    got = islands.numbered(df, ["start", "i"], "n", ["k", F.floor(F.col("start") / 50)]).collect()
    assert [x.n for x in sorted(got, key=lambda x: (x.k, x.start, x.i))] == list(range(1, 201))


def test_positional_and_style_and_sequential_ids(spark):
    current = rows(spark, [("c1", 100 * i, f"AG{i * 100:05d}x") for i in range(1, 8)] + [("c2", 50, "AG05000x"), ("c3", 10, "noname")], "seqid string, start long, gene_id string")
    reserved = rows(spark, [("AG00150x",), ("AG00160x",)], "gene_id string")
    new = rows(spark, [("n1", "c1", 120, 130), ("n2", "c1", 140, 150), ("n3", "c1", 9000, 9001), ("n4", "c1", 5, 6), ("n5", "c2", 60, 70), ("n6", "c9", 1, 2), ("n7", "c3", 20, 30)], "new_id string, seqid string, start long, `end` long")
    got = {x.new_id: x.gene_id for x in lineage.positional_ids(new, current, reserved.union(current.select("gene_id"))).collect()}
    assert got == {"n1": "AG00130x", "n2": "AG00170x", "n3": "AG00800x", "n4": "AG00050x"}
    anchors = rows(spark, [("n5", "AG05000x", "one_to_one_lineage", "s")], "new_id string, gene_id string, basis string, status string")
    made = {x.new_id: (x.gene_id, x.basis, x.collides) for x in lineage.gene_mapping(new, anchors, current, reserved.union(rows(spark, [("QG0002",), ("QG0003",)], "gene_id string")), prefix="QG", width=4, strategy="current_style_or_sequential").collect()}
    assert made["n1"][:2] == ("AG00130x", "current_namespace_genomic_gap") and made["n5"] == ("AG05000x", "one_to_one_lineage", False)
    # c3 and c9 have no style of their own; one style holds most genes, and numbers go on above the largest.
    assert made["n6"][:2] == ("AG05200x", "inferred_dominant_source_id_style") and made["n7"][:2] == ("AG05100x", "inferred_dominant_source_id_style")
    plain = lineage.gene_mapping(new, anchors, current, rows(spark, [("QG0002",), ("QG0003",)], "gene_id string"), prefix="QG", width=4)
    assert sorted(x.gene_id for x in plain.collect()) == ["AG05000x", "QG0001", "QG0004", "QG0005", "QG0006", "QG0007", "QG0008"] and not plain.filter("collides").count()


def test_styles_with_the_sequence_in_them(spark):
    current = rows(spark, [(f"s{k}", f"Bn{'s' + str(k)}G{i:04d}Z") for k in (1, 2) for i in range(10, 70, 10)], "seqid string, gene_id string")
    new = rows(spark, [("a", "s9", 5), ("b", "s9", 3), ("c", "s1", 1)], "new_id string, seqid string, start long")
    got = {x.new_id: (x.gene_id, x.basis) for x in lineage.style_ids(new, current, current.select("gene_id")).collect()}
    assert got == {"b": ("Bns9G0010Z", "inferred_seqid_source_id_style"), "a": ("Bns9G0020Z", "inferred_seqid_source_id_style"), "c": ("Bns1G0070Z", "inferred_local_source_id_style")}
    loc = rows(spark, [("s1", f"LOC{i}") for i in range(1000, 1020)], "seqid string, gene_id string")
    assert lineage.style_ids(new, loc, loc.select("gene_id")).collect() == []


def test_transcript_mapping(spark):
    given = rows(spark, [("G7", "b", 5), ("G7", "a", 9), ("G7", "b", 7), ("G8", "c", 1)], "gene_id string, tx_id string, start long")
    none = rows(spark, [("G8.t01",)], "tx_id string")
    assert {(x.tx_id, x.final_id, x.collides) for x in lineage.transcript_mapping(given, none).collect()} == {("b", "G7.t01", False), ("a", "G7.t02", False), ("c", "G8.t01", True)}
    assert {x.final_id for x in lineage.transcript_mapping(given, none, current_style=True).collect()} == {"T7.1", "T7.2", "T8.1"}


def test_unknown_policy_is_refused():
    with pytest.raises(ValueError):
        rules.policy("any", *[None] * 8)
