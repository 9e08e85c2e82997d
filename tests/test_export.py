"""Proposal catalogue, policy export and support store against plain loops over small files."""

import random

import pytest
from pyspark.sql import functions as F

from locuskit.operators import blocks, proposals, support_store
from locuskit.sources import readers, writers
from tests.test_operators import rows

LINES = "row_idx long, line string"


def attrs_of(text):
    out = {}
    for item in filter(None, (x.strip() for x in text.split(";"))):
        k, v = item.split("=", 1) if "=" in item else item.split(" ", 1)
        out[k] = v.strip().strip('"')
    return out


def plain_blocks(lines):
    """block -> numbers of its lines, one pass after another over the file."""
    parsed = [(i, p, attrs_of(p[8])) for i, x in enumerate(lines) if x and not x.startswith("#") and len(p := x.split("\t")) == 9]
    seen, first, own, tx = {}, {}, {}, {}
    for i, p, a in parsed:
        ident = a.get("ID", "")
        if p[2].lower() == "gene" and ident:
            seen[ident] = seen.get(ident, 0) + 1
            own[i] = ident if seen[ident] == 1 else f"{ident}__duplicate_{seen[ident]}"
            first.setdefault(ident, own[i])
        elif p[2].lower() in ("mrna", "transcript", "rna") and ident:
            parents = a.get("Parent", "").replace(",", " ").split()
            if to := a.get("geneID") or a.get("gene_id") or (parents[0] if parents else ""):
                tx[ident] = to
    out = {b: [i] for i, b in own.items()}
    for i, _, a in parsed:
        if i in own:
            continue
        to = ""
        for x in a.get("Parent", "").replace(",", " ").split():
            if x in first or x in tx:
                to = x if x in first else tx[x]
                break
        to = to or next((a[k] for k in ("geneID", "gene_id") if a.get(k) in first), "")
        if to in first:
            out[first[to]].append(i)
    return {b: sorted(x) for b, x in out.items()}


def drawn(seed, extra=""):
    r = random.Random(seed)
    lines = ["##gff-version 3", "", "short\tline"]
    row = lambda kind, a, s=None: "\t".join([r.choice(["chr2", "chr10", "X"]), "s", kind, str(s or r.randint(1, 900)), str(r.randint(901, 2000)), ".", r.choice("+-"), r.choice("012"), a])
    for i in range(60):
        g = r.randrange(25)
        lines.append(r.choice([row("gene", f"ID=g{g};Name=n" + extra.format(g=g, r=r.randrange(6))), row("mRNA", f"ID=t{i % 30};Parent=g{g}"), row("transcript", f"ID=t{i % 30};Parent=zz;geneID=g{g}"), row("gene", "Name=noid")]))
        for _ in range(r.randrange(4)):
            lines.append(row(r.choice(["exon", "CDS", "five_prime_UTR", "odd"]), r.choice([f"Parent=t{r.randrange(30)}", f"Parent=zz,t{r.randrange(30)},g1", f"Parent=g{g}", f"ID=x;gene_id=g{g}", "Note=none", f'gene_id "g{g}"'])))
    r.shuffle(lines)
    return lines


@pytest.mark.parametrize("seed", range(3))
def test_gene_blocks(spark, seed):
    lines = drawn(seed)
    got = {}
    for x in blocks.gene_blocks(rows(spark, list(enumerate(lines)), LINES)).collect():
        got.setdefault(x.block, []).append(x.row_idx)
        assert x.line == lines[x.row_idx] and x.g_line == lines[x.g_row]
    assert {b: sorted(x) for b, x in got.items()} == plain_blocks(lines)


def test_policy_file(spark, tmp_path):
    """A proposal goes, the two current genes of its ID come back, and every line is as it was in its file."""
    line = lambda seq, kind, a, b, attr: "\t".join([seq, "p", kind, str(a), str(b), ".", "+", "0" if kind == "CDS" else ".", attr])
    told = "proposal_catalog=true;locus_id={};final_call=novel_gene_candidate_manual_review;export_readiness=manual_review_required_before_export;proposal_action=add_novel_selected_set;source_model_id={};replaces_current_genes={}"
    catalog = ["# comment", line("chr10", "gene", 5, 50, "ID=P1;" + told.format("L1", "m1", "")), line("chr10", "mRNA", 5, 50, "ID=P1.t;Parent=P1"), line("chr10", "CDS", 5, 13, "Parent=P1.t"), line("chr10", "exon", 5, 50, "Parent=P1.t"),
               line("chr2", "gene", 7, 90, "ID=P2;" + told.format("L2", "m2", "C1,C2")), line("chr2", "gene", 1, 4, "ID=base;Note=a  b"), line("chr9", "gene", 1, 4, "ID=P3;" + told.format("L3", "m3", "")), line("chr9", "CDS", 1, 3, "Parent=P3")]
    current = [line("chr2", "mRNA", 3, 9, "ID=c1.t;Parent=C1"), line("chr2", "gene", 3, 9, "ID=C1"), line("chr2", "gene", 30, 39, "ID=C1;Note=second"), line("chr2", "gene", 1, 4, "ID=base;Note=a  b"), line("chr1", "gene", 1, 2, "ID=C9")]
    (tmp_path / "p.gff3").write_text("\n".join(catalog) + "\n")
    (tmp_path / "c.gff3").write_text("\n".join(current) + "\n")
    read = lambda n: blocks.gene_blocks(readers.lines(spark, str(tmp_path / n)))
    calls = rows(spark, [(k, "novel_gene_candidate_manual_review", "strong", "false", s) for k, s in (("L1", "ToolA"), ("L2", "ToolA"), ("L3", "ToolA,ToolB,current"))], "locus_id string, final_call string, best_evidence_level string, manual_review_unsupported_locus string, member_real_sources string")
    records = rows(spark, [("P1", "m1x", "r1"), ("P2", "m2", "r2")], "export_gene_id string, source_model_id string, more string")
    models = rows(spark, [("m1x", "partial_junction_support"), ("m2", "none_observed")], "model_id string, rna_junction_status string")
    signature = '["chr9","+",[[1,3,"0"]]]'
    support = rows(spark, [("L3", signature, "ToolA"), ("L3", signature, "ToolB"), ("L3", signature, "current"), ("L1", "other", "ToolA")], "locus_id string, cds_signature string, source string")
    made = blocks.policy_blocks(read("p.gff3"), read("c.gff3"), calls, records, models, support, "supported_novel_singletool_junction_supported")
    assert {(x.block, x.include, x.reason) for x in made["decisions"].collect()} == {
        ("P1", True, "keep_supported_singletool_junction_novel"), ("P2", False, "drop_supported_singletool_no_full_or_partial_junction"), ("P3", True, "keep_supported_multitool_novel"), ("base", True, "keep_current_or_base_backbone"),
    }
    writers.write_lines(blocks.block_order(made["rows"]), F.col("line"), str(tmp_path / "out"), one_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    want = [catalog[6], current[1], current[0], current[2], catalog[7], catalog[8], *[catalog[k] for k in (1, 2, 3, 4)]]
    assert part.read_text().splitlines() == want
    assert [(x.more, x.selected_cds_support_count, x.policy_decision_reason) for x in made["records"].collect()] == [("r1", 0, "keep_supported_singletool_junction_novel")]
    told = {x.metric: x.value for x in blocks.policy_summary(made).collect()}
    assert told["output_gene_blocks"] == 5 and told["restored_current_gene_blocks"] == 2 and told["duplicate_gene_ids_in_output_blocks"] == 1 and told["output_transcripts"] == 2
    strict = blocks.policy_blocks(read("p.gff3"), read("c.gff3"), calls, records, models, support, "strict_supported_novel_multitool_only")
    assert {(x.block, x.reason, tuple(x.sources)) for x in strict["decisions"].collect() if x.block in ("P1", "P3")} == {("P1", "strict_drop_supported_singletool_or_unknown_novel", ()), ("P3", "strict_keep_supported_exact_cds_multitool_novel", ("ToolA", "ToolB"))}


def test_sources_of_all_transcripts(spark):
    """Coding lines without a transcript count together where the gene has none or is named."""
    line = lambda kind, a, b, attr, phase=".": "\t".join(["c", "p", kind, str(a), str(b), ".", "-", phase, attr])
    text = [line("gene", 1, 9, "ID=a;locus_id=L"), line("mRNA", 1, 9, "ID=a1;Parent=a"), line("mRNA", 1, 9, "ID=a2;Parent=a"), line("CDS", 1, 3, "Parent=a1,a2", "0"), line("CDS", 5, 9, "Parent=a2", "0"), line("CDS", 5, 6, "Parent=a", "1"),
            line("gene", 1, 9, "ID=b;locus_id=L"), line("CDS", 2, 3, "gene_id=b", "0"), line("CDS", 1, 1, "Parent=b", "0")]
    got = {(x.block, x.cds_signature) for x in blocks.coding_signatures(blocks.gene_blocks(rows(spark, list(enumerate(text)), LINES))).collect()}
    assert got == {("a", '["c","-",[[1,3,"0"]]]'), ("a", '["c","-",[[1,3,"0"],[5,9,"0"]]]'), ("a", '["c","-",[[5,6,"1"]]]'), ("b", '["c","-",[[1,1,"0"],[2,3,"0"]]]')}
    needs = rows(spark, [("k", 1), ("k", 2), ("k", 2), ("l", 3)], "key string, item int")
    has = rows(spark, [(1, "A"), (2, "A"), (2, "A"), (2, "B"), (3, "B"), (9, "A")], "item int, source string")
    assert {tuple(x) for x in blocks.supported_by_all(needs, has, ["item"], "key").collect()} == {("k", "A"), ("l", "B")}


def test_backbone(spark):
    line = lambda kind, attr: "\t".join(["c", "p", kind, "1", "9", ".", "+", ".", attr])
    text = ["#x", "", "broken\tline", line("gene", "ID=g1"), line("gene", "Name=g2"), line("gene", "ID=g3"), line("mRNA", "ID=t1;Parent=g1"), line("mRNA", "ID=t3;Parent=g3"), line("mRNA", "ID=t9;Parent=g3,g2"), line("exon", "Parent=t1"), line("exon", "Parent=t3,t1"), line("exon", "Parent=t3"), line("exon", "Parent=t9"), line("repeat", "")]
    got = blocks.backbone(rows(spark, list(enumerate(text)), LINES), rows(spark, [("g1",), ("g2",)], "gene_id string"))
    assert sorted(x.row_idx for x in got.collect()) == [2, 5, 7, 11, 12, 13]


MODEL = "model_id string, source string, gene_id string, transcript_id string, source_gene_id string, source_transcript_id string, seqid string, strand string, start int, `end` int, exons array<struct<start:int,end:int>>, cds array<struct<start:int,end:int>>"


def card(locus, row, *models):
    whole = lambda m: tuple(m.get(k) for k in ("model_id", "source", "gene_id", "transcript_id", "source_gene_id", "source_transcript_id", "seqid", "strand", "start", "end", "exons", "cds"))
    return locus, row, [whole(m) for m in models]


def test_catalogue(spark):
    a = {"model_id": "ToolA:ga:t1", "seqid": "c1", "strand": "-", "start": 10, "end": 99, "exons": [(10, 40), (60, 99), (10, 40)], "cds": [(60, 90), (20, 40)]}
    b = {"model_id": "ToolA:gb:t2", "source": "ToolA", "seqid": "c1", "strand": "+", "start": 5, "end": 8, "exons": [], "cds": [(5, 8)]}
    c = {"model_id": "ToolA:ga:t0", "seqid": "c1", "strand": "-", "start": 10, "end": 70, "exons": [(10, 70)], "cds": None}
    cur = {"model_id": "current:G1:T1", "seqid": "c1", "strand": "-", "start": 1, "end": 80, "exons": [(1, 80)], "cds": []}
    schema = f"locus_id string, row_idx long, candidate_models array<struct<{MODEL.replace(' string', ':string').replace(' int', ':int').replace(' array', ':array')}>>"
    cards = rows(spark, [card("L 1", 0, cur), card("L 1", 1, cur, a, b, {**c, "seqid": "old"}, c), card("L2", 2, cur), card("L3", 3, b), card("", 4, b), card("L4", 5, b)], schema)
    given = [
        ("L 1", 1, {"final_call": "replace_current_candidate", "selected_model_id": "ToolA:ga:t1,ToolA:ga:t0;ToolA:gb:t2,absent", "selected_real_set_id": "S 1", "risk_tags": "x,y z", "manual_review_novel_gene_candidate": "TRUE"}),
        ("L 1", 0, {"final_call": "keep_current"}), ("L2", 2, {"final_call": "keep_current_flagged"}), ("L3", 3, {"final_call": "novel", "selected_real_model_ids": "ToolA:gb:t2"}),
    ]
    calls = rows(spark, [(k, i, *(v.get(c) for c in proposals.CALL)) for k, i, v in given], "locus_id string, row_idx long, " + ", ".join(f"{c} string" for c in proposals.CALL))
    made = proposals.catalogue(cards, calls, prefix="Prop")
    lines = [(x.feature, x.start, x.end, x.strand, x.phase, x.attributes) for x in proposals.catalogue_order(made["features"]).collect()]
    p, q = "Prop_L_1_S_1_g02", "Prop_L_1_S_1_g01"
    told = "proposal_catalog=true;proposal_status=not_final_annotation;locus_id=L%201;"
    flags = "review_flags=manual_review_novel_gene_candidate"
    mine = [x for x in lines if "L_1" in x[5]]
    assert mine[0][5] == f"ID={q};Name={q};{told}proposal_action=replace_current_with_selected_set;selected_set_id=S%201;source_gene_id=gb;source_model_id=ToolA:gb:t2;replaces_current_genes=G1;final_call=replace_current_candidate;{flags};risk_tags=x,y%20z"
    assert [x[:5] for x in mine] == [
        ("gene", 5, 8, "+", "."), ("mRNA", 5, 8, "+", "."), ("exon", 5, 8, "+", "."), ("CDS", 5, 8, "+", "0"),
        ("exon", 10, 40, "-", "."), ("mRNA", 10, 70, "-", "."), ("exon", 10, 70, "-", "."), ("gene", 10, 99, "-", "."), ("mRNA", 10, 99, "-", "."), ("CDS", 20, 40, "-", "2"), ("exon", 60, 99, "-", "."), ("CDS", 60, 90, "-", "0"),
    ]
    assert {x[5].split(";")[0] for x in mine if x[0] == "mRNA"} == {f"ID={q}.t01", f"ID={p}.t01", f"ID={p}.t02"}
    assert any(x[5] == f"ID={p}.t02;Parent={p};Name={p}.t02;{told}selected_set_id=S%201;source_model_id=ToolA:ga:t1;source=ToolA;source_gene_id=ga;source_transcript_id=t1;{flags}" for x in mine)
    assert {(x[5], x[4]) for x in mine if x[0] == "CDS" and p in x[5]} == {(f"ID={p}.t02.cds1;Parent={p}.t02", "2"), (f"ID={p}.t02.cds2;Parent={p}.t02", "0")}
    records = {(x.locus_id, x.export_transcript_id): x for x in made["records"].collect()}
    assert set(records) == {("L 1", f"{q}.t01"), ("L 1", f"{p}.t01"), ("L 1", f"{p}.t02"), ("L2", None), ("L3", "Prop_L3_unknown_g01.t01"), ("L4", None)}
    r = records["L 1", f"{p}.t02"]
    assert (r.exon_count, r.cds_count, r.cds_length, r.removed_current_gene_ids, r.start, r.end) == (3, 2, 52, "G1", 10, 99)
    assert records["L2", None].proposal_action == "keep_current" and records["L4", None].proposal_action == "keep_current_no_selected_model" and records["L3", "Prop_L3_unknown_g01.t01"].proposal_action == "add_novel_selected_set"
    assert {x.gene_id for x in made["removed"].collect()} == {"G1"} and {x.locus_id for x in made["review"].collect()} == {"L 1", "L2"}
    told = {x.metric: x.value for x in proposals.catalogue_summary(made).collect()}
    assert (told["card_loci"], told["missing_call_loci"], told["missing_selected_models"], told["proposal_transcript_records"], told["final_call:missing_final_call"]) == (4, 1, 1, 4, 1)


def test_support_store(spark, tmp_path):
    schema = "locus_id string, source string, seqid string, strand string, cds array<struct<start:int,end:int,phase:string>>"
    first = [("L1", "Tool A", "c", "+", [(1, 3, "0")]), ("L1", "Tool/B", "c", "+", [(1, 3, "0")]), ("L2", "Tool/B", "c", "-", []), ("L1", "Current", "c", "+", [(1, 3, "0")]), ("L3", "ToolC", "c", "+", [(9, 11, "0")])]
    store = str(tmp_path / "store")
    held, changed = support_store.refreshed(store, rows(spark, first, schema))
    assert changed == ["Tool A", "Tool/B", "ToolC"] and {(x.locus_id, x.source) for x in held.collect()} == {("L1", "Tool A"), ("L1", "Tool/B"), ("L3", "ToolC")}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert support_store.refreshed(store, rows(spark, first[::-1], schema))[1] == []
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")} == before
    second = [first[0], ("L1", "Tool/B", "c", "+", [(1, 4, "0")]), ("L2", "ToolD", "d", "+", [(1, 3, "0")])]
    held, changed = support_store.refreshed(store, rows(spark, second, schema))
    assert changed == ["Tool/B", "ToolD"] and {(x.locus_id, x.cds_signature, x.source) for x in held.collect()} == {("L1", '["c","+",[[1,3,"0"]]]', "Tool A"), ("L1", '["c","+",[[1,4,"0"]]]', "Tool/B"), ("L2", '["d","+",[[1,3,"0"]]]', "ToolD")}
    same = [p for p in (tmp_path / "store").rglob("*.parquet") if p in before]
    assert same and all("546F6F6C2041" in str(p) for p in same if "support" in str(p))
    assert {tuple(x)[2:] for x in support_store.cache_rows(rows(spark, [("L", "s", "b"), ("L", "s", "a")], "locus_id string, cds_signature string, source string")).collect()} == {("a,b", 2)}
    assert support_store.refreshed(store, rows(spark, [], schema))[0].count() == 0
