"""Edges between models on small fixtures worked out by hand."""

import random

from locuskit.operators import evidence

MODEL = "tx_id string, seqid string, strand string, source string, gene_id string, start long, `end` long, blocks array<struct<start:long,end:long>>, coding array<struct<start:long,end:long>>, gaps array<struct<start:long,end:long>>"


def test_protein_bridges_give_the_components_of_all_compatible_pairs(spark):
    rnd = random.Random(5)
    models = [(f"m{i:02d}", "c", rnd.choice("+-.") if i % 3 else "+", 1 + rnd.randrange(900)) for i in range(60)]
    hits = [(f"h{i}", "c", rnd.choice("+-."), 1 + rnd.randrange(900)) for i in range(12)]
    m = spark.createDataFrame([(a, b, c, s, s + 30) for a, b, c, s in models], "tx_id string, seqid string, strand string, start long, `end` long")
    h = spark.createDataFrame([(a, b, c, s, s + 60) for a, b, c, s in hits], "hit_id string, seqid string, strand string, start long, `end` long")
    strand = {a: c for a, _, c, _ in models}
    fits = lambda a, b: strand[a] == strand[b] or "." in (strand[a], strand[b])

    def groups(pairs):
        root = {a: a for a in strand}
        for _ in strand:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    for flank in (0, 20):
        near = {i: [a for a, _, _, s in models if s - flank <= t + 60 and t - flank <= s + 30] for i, _, _, t in hits}
        want = {(a, b) for met in near.values() for a in met for b in met if a < b and fits(a, b)}
        got = evidence.protein_bridges(m, h, flank=flank).collect()
        assert {(r.a, r.b) for r in got} <= want and groups([(r.a, r.b) for r in got]) == groups(want)
        assert all(r.a in near[r.hit_id] and r.b in near[r.hit_id] for r in got)


def test_table_of_edges(spark):
    block = lambda *x: [(a, b) for a, b in x]
    rows = [
        ("a", "c", "+", "s", "g", 1, 100, block((1, 20), (50, 100)), block((5, 20)), block((21, 49))), ("b", "c", ".", "s", "g", 11, 100, block((11, 20), (50, 100)), block((11, 20)), block((21, 49))),
        ("d", "c", "+", "s", "", 200, 300, block((200, 300)), [], []), ("e", "c", "+", "s", "", 400, 420, block((400, 420)), [], []), ("f", "c", "-", "s", None, 400, 420, block((400, 420)), [], []),
    ]
    hits = spark.createDataFrame([("p|1", "c", 250, 410, "T 1 9")], "hit_id string, seqid string, start long, `end` long, target string")
    junctions = spark.createDataFrame([("c", 98, 205, "+", 7, 2), ("c", 98, 205, "-", 9, 9)], "seqid string, start long, `end` long, strand string, reads long, samples long")
    got = {(r.model_id_a, r.model_id_b, r.edge_type): (r.edge_strength, r.strand, r.evidence_detail) for r in evidence.unit_edges(spark.createDataFrame(rows, MODEL), hits, junctions).collect()}
    mixed = "compatible_or_mixed"
    assert got == {
        ("a", "b", "span_overlap"): ("moderate", mixed, "overlap_bp=90;frac_a=0.9000;frac_b=1.0000"), ("a", "b", "exon_overlap"): ("strong", mixed, "overlap_bp=61"), ("a", "b", "CDS_overlap"): ("strong", mixed, "overlap_bp=10"),
        ("a", "b", "identical_intron_chain"): ("strong", mixed, "intron_count=1"), ("a", "b", "terminal_boundary_difference_only"): ("moderate", mixed, "same_intron_chain_with_different_span"), ("a", "b", "same_source_gene"): ("strong", mixed, "source=s;gene_id=g"),
        ("a", "d", "RNA_junction_bridge"): ("strong", "+", "c:98-205:+;support=7;samples=2"), ("b", "d", "RNA_junction_bridge"): ("strong", mixed, "c:98-205:+;support=7;samples=2"), ("d", "e", "protein_bridge"): ("moderate", "+", "protein_hit=p|1;target=T 1 9"),
    }
