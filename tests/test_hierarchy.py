"""Repair of hierarchies, duplicate identifiers and release checks on small fixtures worked out by hand."""

from locuskit.operators import contracts, hierarchy

SCHEMA = "row_idx long, seqid string, source string, feature string, start long, `end` long, strand string, phase string, id string, parents array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, "c1", "s", f, a, b, st, ph, ident, ps) for i, (f, a, b, st, ph, ident, ps) in enumerate(rows)], SCHEMA)


def test_duplicates_and_their_parents(spark):
    rows = [("gene", 1, 9, "+", ".", "g", []), ("mRNA", 1, 9, "+", ".", "t", ["g"]), ("exon", 1, 4, "+", ".", "e", ["t"]), ("gene", 20, 29, "+", ".", "g", []), ("mRNA", 20, 29, "+", ".", "t", ["g"]), ("exon", 20, 24, "+", ".", "e", ["t", "far"]), ("gene", 40, 49, "+", ".", "g.dup03", []), ("gene", 60, 69, "+", ".", "g", []), ("mRNA", 60, 69, "+", ".", None, ["g"])]
    got = {r.row_idx: (r.final_id, r.final_parents) for r in hierarchy.disambiguated(frame(spark, rows)).collect()}
    assert got == {0: ("g", []), 1: ("t", ["g"]), 2: ("e", ["t"]), 3: ("g.dup02", []), 4: ("t.dup02", ["g.dup02"]), 5: ("e", ["t.dup02", "far"]), 6: ("g.dup03", []), 7: ("g.dup04", []), 8: (None, ["g.dup04"])}


def test_repair(spark):
    rows = [
        ("gene", 10, 20, "+", ".", "g1", []), ("mRNA", 10, 20, "+", ".", "g1", ["g1"]), ("exon", 5, 12, "-", "1", "e", ["g1"]), ("CDS", 5, 12, "+", "x", "c", ["g1"]),
        ("mRNA", 100, 150, "-", ".", "t2", []), ("CDS", 100, 120, "-", "0", "c", ["t2"]), ("CDS", 121, 130, "-", "2", "c", ["t2"]), ("three_prime_UTR", 140, 160, "-", ".", None, ["t2"]),
        ("lnc_RNA", 200, 210, ".", ".", "t3", ["lost"]), ("lnc_RNA", 190, 205, ".", ".", "t4", ["lost"]), ("exon", 1, 2, "+", ".", "orphan", ["nowhere"]), ("gene", 300, 310, "+", ".", "g1", []), ("gene", 400, 410, "+", ".", None, []), ("region", 1, 999, ".", ".", "r", []),
        ("exon", 200, 205, "+", ".", "shared", ["t3", "t4"]),
    ]
    df = frame(spark, rows)
    got = {(r.feature, r.id, r.start): (r.end, r.strand, r.phase, tuple(r.parents), r.repair) for r in hierarchy.repaired(df, "made").collect()}
    assert got == {
        ("gene", "g1", 5): (20, "+", ".", (), ""), ("mRNA", "g1.t01", 5): (20, "+", ".", ("g1",), ""), ("exon", "e", 5): (12, "+", ".", ("g1.t01",), ""), ("CDS", "c", 5): (12, "+", "0", ("g1.t01",), ""),
        ("gene", "t2", 100): (160, "-", ".", (), "synthetic_gene_from_top_level_transcript"), ("mRNA", "t2.t01", 100): (160, "-", ".", ("t2",), ""), ("CDS", "c.dup02", 100): (120, "-", "0", ("t2.t01",), ""), ("CDS", "c.dup03", 121): (130, "-", "2", ("t2.t01",), ""),
        ("three_prime_UTR", None, 140): (160, "-", ".", ("t2.t01",), ""), ("exon", "t2.t01.exon001", 100): (130, "-", ".", ("t2.t01",), "synthetic_exon_from_cds_or_utr"), ("exon", "t2.t01.exon002", 140): (160, "-", ".", ("t2.t01",), "synthetic_exon_from_cds_or_utr"),
        ("gene", "lost", 190): (210, ".", ".", (), "synthetic_gene_from_transcript_parent"), ("lnc_RNA", "t3", 200): (210, ".", ".", ("lost",), ""), ("lnc_RNA", "t4", 190): (205, ".", ".", ("lost",), ""), ("exon", "shared", 200): (205, ".", ".", ("t3", "t4"), ""),
        ("gene", "g1.dup02", 300): (310, "+", ".", (), ""), ("gene", "gene_12", 400): (410, "+", ".", (), ""), ("region", "r", 1): (999, ".", ".", (), ""),
    }
    assert {r.check: r.n for r in hierarchy.post_checks(hierarchy.repaired(df, "made")).collect()} == dict.fromkeys(("duplicate_gene_tx_exon_ids", "invalid_cds_phase", "invalid_non_cds_phase", "missing_parent_refs", "child_outside_parent"), 0)
    assert {r.check: r.n for r in hierarchy.post_checks(df).collect()} == {"duplicate_gene_tx_exon_ids": 2, "invalid_cds_phase": 1, "invalid_non_cds_phase": 1, "missing_parent_refs": 3, "child_outside_parent": 3}
    assert hierarchy.repaired(df.limit(0)).collect() == []


def test_protein_lines(spark):
    lines = ["##x", "", "c\ts\tmatch\t5\t9\t.\t+\t.\tID=h;Target=p 1 5;Identity=0.9", "c\ts\tmatch_part\t5\t9\t.\t+\t.\tParent=h", "c\ts\tcDNA_match\t9\t5\t.\t+\t.\tID=k", "c\ts\tgene\t0\t0\t.\t+\t.\tID=k", "c\ts\tmatch"]
    assert tuple(contracts.protein_faults(spark.createDataFrame([(x,) for x in lines], "line string")).first()) == (5, 2, 2, 1, 1, 1)
    df = spark.createDataFrame([("1", "9", "0.5"), ("9", "1", "x"), ("", "9", "")], "intron_start_1based string, intron_end_1based string, f string")
    assert contracts.missing_columns(df, ["strand", "f"]) == ["strand"]
    assert [r.fault for r in contracts.junction_faults(df).collect()] == ["counts", "coordinates", "coordinates"] and [r.fault for r in contracts.fraction_faults(df, ["f"]).collect()] == [False, True, False]
