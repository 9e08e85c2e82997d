"""The summary of identifiers on a small run worked out by hand."""

from locuskit.operators.identifier_summary import identifier_summary


def test_summary_of_a_small_run(spark):
    calls = spark.createDataFrame([("L1", "replace", "A:g1:t1, B:g2", "", "x"), ("L2", "keep_current", "", "current:c9:c9.t1", None), ("L3", "", None, None, "")], "locus_id string, final_call string, selected_real_model_ids string, selected_model_id string, risk_tags string")
    models = spark.createDataFrame([("L1", "A:g1:t1", "toolA", "", "G"), ("L2", "A:g1:t1", "no", "no", "no")], "locus_id string, model_id string, source string, source_gene_id string, gene_id string")
    proposals = spark.createDataFrame([("L1", 2, "c2,c1", "V2PROP_1", "b"), ("L1", 1, "c1", "V2PROP_2", " x "), ("L2", 3, "c9", "", "")], "locus_id string, row_idx long, current_gene_ids string, export_gene_id string, risk_tags string")
    genes = spark.createDataFrame([("L1", 1, "", "c3", "F1", "true", "merge_replacement", "V2PROP_2"), ("L1", 2, None, "c1", "F2", "false", "merge_replacement", None)], "locus_id string, row_idx long, current_gene_ids string, removed_current_gene_ids string, final_gene_id string, reuse_current_gene_id string, final_relation string, proposal_gene_id string")
    tx = spark.createDataFrame([("L1", 1, "F1.t01")], "locus_id string, row_idx long, final_transcript_id string")
    got = {r.locus_id: r for r in identifier_summary(calls, models, proposals, genes, tx).collect()}
    one, two, three = got["L1"], got["L2"], got["L3"]
    assert (one.change_class, one.current_gene_ids, one.final_gene_ids, one.reuse_current_gene_ids, one.final_transcript_ids) == ("merge_replacement", "c1;c2;c3", "F1;F2", "F1", "F1.t01")
    assert (one.proposal_gene_ids, one.selected_model_ids, one.source_sources, one.source_gene_ids, one.source_transcript_ids, one.risk_tags) == ("Proposal_2;Proposal_1", "A:g1:t1;B:g2", "toolA;B", "G;g2", "t1", "x;b")
    assert (two.change_class, two.final_gene_ids, two.source_transcript_ids, two.replacement_interpretation) == ("keep_current", "c9", "c9.t1", "Current gene model is retained.")
    assert (three.change_class, three.current_gene_ids, three.selected_model_ids, three.call_group) == ("unknown", "", "", "")
    bare = {r.locus_id: (r.workflow_mode, r.change_class) for r in identifier_summary(calls, models.limit(0), proposals.limit(0), genes.limit(0), tx.limit(0), with_current=False).collect()}
    assert bare == dict.fromkeys(("L1", "L2", "L3"), ("arbitration", "no_current_arbitration_selection"))
    assert identifier_summary(calls.limit(0), models, proposals, genes, tx).collect() == []
