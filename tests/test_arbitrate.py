"""A whole run over small files, and the audit of coding models."""

from pyspark.sql import functions as F

from locuskit.operators import eligibility
from locuskit.plans import arbitrate


def gff(gene, blocks, coding, strand="+", seqid="chr1"):
    s, e = min(b[0] for b in blocks), max(b[1] for b in blocks)
    row = lambda f, a, b, x, p=".": f"{seqid}\tx\t{f}\t{a}\t{b}\t.\t{strand}\t{p}\t{x}"
    out = [row("gene", s, e, f"ID={gene}"), row("mRNA", s, e, f"ID={gene}.t01;Parent={gene}")]
    return out + [row("exon", *b, f"Parent={gene}.t01") for b in blocks] + [row("CDS", *b, f"Parent={gene}.t01", "0") for b in coding]


def test_run_files(spark, tmp_path):
    shared = ([(100, 200), (300, 500)], [(120, 200), (300, 470)])
    files = {
        "current": gff("cur1", *shared) + gff("cur2", [(5000, 5400)], [(5010, 5300)]),
        "ToolA": gff("a1", *shared) + gff("a2", [(9000, 9100), (9200, 9300)], [(9000, 9100), (9200, 9260)], "-"),
        "ToolB": gff("b1", [(100, 200), (330, 530)], [(120, 200), (330, 500)]),
    }
    for name, rows in files.items():
        (tmp_path / f"{name}.gff3").write_text("\n".join(rows) + "\n")
    (tmp_path / "s1.tab").write_text("chr1\t201\t299\t1\t1\t0\t8\t0\t30\nchr1\t9101\t9199\t2\t2\t0\t5\t0\t20\n")
    run = arbitrate.run_files(spark, {n: str(tmp_path / f"{n}.gff3") for n in files}, str(tmp_path / "out"), {"s1": str(tmp_path / "s1.tab")})
    status = {r.tx_id: r.status for r in run["status"].collect()}
    assert status["current:cur1:cur1.t01"] == status["ToolA:a1:a1.t01"] == "full_junction_support" and status["ToolB:b1:b1.t01"] == "conflicting_junction" and status["current:cur2:cur2.t01"] == "not_assessable"
    calls = {r.locus_id: r for r in run["calls"].collect()}
    assert [(calls[k].source, calls[k].action, calls[k].relation) for k in sorted(calls)] == [("current", "keep_current", "other_proposal"), ("current", "keep_current", "other_proposal"), ("ToolA", "add_novel_selected_set", "novel_gene")]
    text = "".join(p.read_text() for p in (tmp_path / "out/merged.gff3").glob("part-*"))
    assert [x.split("\t")[8] for x in text.splitlines() if "\tgene\t" in x] == ["ID=current:cur1", "ID=current:cur2", "ID=ToolA:a2"]
    assert [x.split("\t")[7] for x in text.splitlines() if "\tCDS\t" in x and "9" in x.split("\t")[3][:1]] == ["2", "0"]
    best = arbitrate.arbitrate(arbitrate.candidates(spark, {n: str(tmp_path / f"{n}.gff3") for n in ("current", "ToolB")}), spark.createDataFrame([], arbitrate.JUNCTION_SCHEMA), spark.createDataFrame([], arbitrate.HIT_SCHEMA), ["current"], "recommended")
    assert best["calls"].count() == 2


def test_audit(spark):
    schema = "tx string, source string, strand string, blocks array<struct<start:int,end:int>>, coding array<struct<start:int,end:int>>, phases array<int>, seq string"
    good = "CCATGAAAGTCCCCAGAAATAGCC"
    rows = [
        ("good", "a", "+", [(3, 8), (17, 22)], [(3, 8), (17, 22)], [0, 0], good), ("none", "a", ".", [], [], None, None), ("short", "a", "+", [(3, 7)], [(3, 7)], [0], good), ("beyond", "a", "+", [(3, 80)], [(3, 80)], None, good),
        ("stop", "a", "+", [(1, 9)], [(1, 9)], None, "ATGTAATAG"), ("phase", "a", "+", [(3, 8), (17, 22)], [(3, 8), (17, 22)], [0, 1], good), ("outside", "a", "+", [(3, 5)], [(3, 8)], None, good),
    ]
    got = {r.tx: r for r in eligibility.audited(spark.createDataFrame(rows, schema)).collect()}
    assert got["good"].hard == [] and got["good"].warnings == [] and got["good"].status == "pass"
    assert got["none"].hard == ["invalid_or_missing_strand", "no_CDS_features", "no_exon_features", "seqid_not_found_in_genome"]
    assert got["short"].hard == ["CDS_length_mod3_invalid"] and "missing_stop_codon" in got["short"].warnings
    assert "transcript_coordinates_out_of_bounds" in got["beyond"].hard and "CDS_sequence_unavailable_or_out_of_bounds" in got["beyond"].hard
    assert got["stop"].hard == ["internal_stop_present"] and got["phase"].hard == ["phase_inconsistent"] and got["outside"].hard == ["CDS_not_nested_within_exon"]
    audit = spark.createDataFrame(rows[:1], schema).transform(eligibility.audited)
    conflicts = spark.createDataFrame([("good", "other", 9)], "a string, b string, bp long")
    told = eligibility.with_conflicts(audit, conflicts, "tx").select("hard", "eligible").first()
    assert told.hard == ["same_source_different_gene_high_overlap:other:overlap_bp_9"] and not told.eligible
    assert eligibility.audited(audit.select(*[F.col(c.split()[0]) for c in schema.split(", ")]).limit(0)).collect() == []


def test_run_with_sequences_and_long_reads(spark, tmp_path):
    """A model with an inner stop can't replace the current gene; long reads lift the score of the source that has them."""
    codon = "ATG" + "GCA" * 28 + "TAA"
    genome = "N" * 99 + codon + "N" * 210 + "ATGTAA" + "GCA" * 27 + "TAA" + "N" * 600
    (tmp_path / "g.fa").write_text(">chr1 first\n" + "\n".join(genome[i : i + 50] for i in range(0, len(genome), 50)) + "\n")
    files = {"current": gff("cur1", [(100, 189)], [(100, 189)]), "ToolA": gff("a1", [(400, 489)], [(400, 489)]) + gff("a2", [(100, 189)], [(100, 189)]), "ToolB": gff("b1", [(5000, 5089)], [(5000, 5089)]), "ToolC": gff("c1", [(100, 189)], [(100, 189)])}
    for name, rows in files.items():
        (tmp_path / f"{name}.gff3").write_text("\n".join(rows) + "\n")
    (tmp_path / "long/ToolA").mkdir(parents=True)
    (tmp_path / "long/ToolA/long_read_model_support_by_model.tsv").write_text("model_id\tsupport_class\tconflicting_chain_count\trisk_tags\na2.t01\texact_chain_supported\t0\tdeep\n")
    (tmp_path / "long/ToolA/long_read_set_support_by_locus.tsv").write_text("locus_id\tsupport_level\texact_supported_transcripts\na2\tstrong\t1\n")
    (tmp_path / "s1.tsv").write_text("chrom\tintron_start_1based\tintron_end_1based\tstrand\tjunction_read_count\nchr1\t120\t150\t+\t7\n")
    run = arbitrate.run_files(spark, {n: str(tmp_path / f"{n}.gff3") for n in files}, str(tmp_path / "out"), {"s1": str(tmp_path / "s1.tsv")}, None, "recommended", str(tmp_path / "g.fa"), str(tmp_path / "long"))
    audit = {r.tx_id: (r.eligible, r.quality, tuple(r.hard)) for r in run["audit"].collect()}
    assert audit["current:cur1:cur1.t01"] == (True, "pass", ()) and audit["ToolA:a1:a1.t01"] == (False, "fail", ("internal_stop_present",))
    assert not audit["ToolB:b1:b1.t01"][0] and "transcript_coordinates_out_of_bounds" in audit["ToolB:b1:b1.t01"][2]
    sets = {r.source: r for r in run["sets"].collect()}
    assert set(sets) == {"current", "ToolA", "ToolC"} and sets["ToolA"].score > sets["ToolC"].score and sets["ToolA"]["pass"] == 1 and sets["ToolA"].exact == 1
    assert [(r.source, r.action) for r in run["calls"].collect()] == [("ToolA", "replace_current_with_selected_set")]
    assert run["junctions"].first().reads == 7


def test_neighbours_of_one_source_take_no_part(spark, tmp_path):
    """Two genes of one tool share nearly all of their place: neither is eligible; a summary made elsewhere does the same."""
    codon = "ATG" + "GCA" * 28 + "TAA"
    (tmp_path / "g.fa").write_text(">chr1\n" + "N" * 99 + codon + "N" * 70_000 + "\n")
    files = {"current": gff("cur1", [(100, 189)], [(100, 189)]), "ToolA": gff("a1", [(100, 189)], [(100, 189)]) + gff("a2", [(103, 189)], [(103, 189)]), "ToolB": gff("b1", [(100, 189)], [(100, 189)])}
    for name, rows in files.items():
        (tmp_path / f"{name}.gff3").write_text("\n".join(rows) + "\n")
    run = arbitrate.run_files(spark, {n: str(tmp_path / f"{n}.gff3") for n in files}, str(tmp_path / "out"), None, None, "recommended", str(tmp_path / "g.fa"))
    audit = {r.tx_id.split(":")[1]: r for r in run["audit"].collect()}
    assert [audit[k].eligible for k in ("cur1", "a1", "a2", "b1")] == [True, False, False, True]
    assert "same_source_different_gene_high_overlap:ToolA:a2:a2.t01:overlap_bp_87" in audit["a1"].hard
    assert {r.source for r in run["sets"].collect()} == {"current", "ToolB"}
    (w,) = run["windows"].collect()
    assert (w.span, w.models, w.sources, w.current_genes, w.window_risks) == (90, 2, 2, 1, [])
    models = arbitrate.candidates(spark, {n: str(tmp_path / f"{n}.gff3") for n in files})
    told = spark.createDataFrame([("ToolA:a1:a1.t01", "fail", False), ("ToolB:b1:b1.t01", "warning", True)], "tx_id string, quality string, eligible boolean")
    run = arbitrate.arbitrate(models, spark.createDataFrame([], arbitrate.JUNCTION_SCHEMA), spark.createDataFrame([], arbitrate.HIT_SCHEMA), ["current"], validation=told)
    assert {r.tx_id.split(":")[1]: r.quality for r in run["audit"].collect()} == {"cur1": "not_assessed", "a1": "fail", "a2": "not_assessed", "b1": "warning"}
    assert "a1" not in {r.tx_id.split(":")[1] for r in run["models"].join(run["loci"], "tx_id").collect()}


def test_long_locus_with_weak_edges_is_a_risk(spark, tmp_path):
    (tmp_path / "current.gff3").write_text("\n".join(gff("c1", [(1, 100), (60_000, 120_000)], [])) + "\n")
    (tmp_path / "ToolA.gff3").write_text("\n".join(gff("a1", [(200, 300), (50_000, 50_100)], [])) + "\n")
    models = arbitrate.candidates(spark, {n: str(tmp_path / f"{n}.gff3") for n in ("current", "ToolA")})
    run = arbitrate.arbitrate(models, spark.createDataFrame([], arbitrate.JUNCTION_SCHEMA), spark.createDataFrame([], arbitrate.HIT_SCHEMA), ["current"])
    (w,) = run["windows"].collect()
    assert w.window_risks == ["long_window_weak_bridge_only_for_AI", "window_span_above_hard_limit_for_AI"]
