"""Interval index, keyed decision log, normaliser and public cards."""

import json
import random

import pytest
from pyspark.sql import functions as F

from locuskit.operators import normalise, public_cards, range_join
from locuskit.sources import readers
from locuskit.streaming import junctions as stream
from tests.test_operators import rows

INTERVAL = "id int, seqid string, start long, `end` long"


@pytest.mark.parametrize("widen", [0, 50])
def test_interval_index(spark, widen):
    r = random.Random(widen)
    draw = lambda n: [(i, r.choice(["a", "b", None]), s := r.randint(0, 60_000), s + r.choice([1, 30, 900, 5000, 40_000])) for i in range(n)]
    indexed, asked = draw(150), draw(60)
    index = range_join.IntervalIndex.build(rows(spark, indexed, INTERVAL), ["seqid"], f"intervals_{widen}", 3)
    for part in (asked, asked[:20]):  # one index, several probes
        got = sorted((x.id, x.id_r) for x in index.probe(rows(spark, part, INTERVAL), widen).collect())
        assert got == sorted((i, j) for i, p, s, e in part for j, q, t, u in indexed if p and p == q and s - widen <= u and t <= e + widen)


def test_index_is_not_shuffled(spark):
    df = rows(spark, [(i, "a", 10 * i, 10 * i + 5) for i in range(500)], INTERVAL)
    index = range_join.IntervalIndex.build(df, ["seqid"], "intervals_plan", 4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.probe(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    join = plan[plan.index("SortMergeJoin") :]
    below = join[join.index("intervals_plan") - 400 : join.index("intervals_plan")]
    assert "Bucketed: true" in join and "Exchange" not in below.split("\n")[-2] + below.split("\n")[-1]
    assert sum("Exchange hashpartitioning" in x for x in join.split("\n")) == 1  # the probe's own


def test_log_reads_touched_partitions_only(spark, tmp_path):
    """Thirty batches later, a batch of one card still reads its own partition alone; a restart changes nothing."""
    source, sink, check = (str(tmp_path / x) for x in ("cards", "log", "check"))
    decide = lambda df: df.select("card_id", (F.col("card_id") % 7 != 0).alias("fine"))
    run = lambda: stream.decided(stream.arriving(spark, source, spark.read.parquet(source).schema, 100), decide, sink, check, buckets=16, valid="fine").awaitTermination(120)
    for batch in (range(0, 40), range(30, 60), [3, 3, 7]):
        spark.createDataFrame([(i,) for i in batch], "card_id long").coalesce(1).write.parquet(source, mode="append")
        run()
    run()
    log = spark.read.parquet(sink)
    assert sorted(x.card_id for x in log.filter("fine").collect()) == [i for i in range(60) if i % 7]
    assert log.filter("card_id = 7").count() == 2 and log.filter("card_id = 35").count() == 2  # not valid, so decided again
    touched = spark.createDataFrame([(3,)], "card_id long").select(stream.bucket_of(F.col("card_id"), 16)).first()[0]
    held = stream.logged(spark, sink, [touched])
    files = {x[0] for x in held.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"/bucket={touched}/" in f for f in files) and held.count() < log.count() / 4
    assert "PartitionFilters: [isnotnull(bucket" in held._jdf.queryExecution().executedPlan().toString() or "bucket" in held._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]
    best = stream.best_records(log, "card_id", F.col("fine"), "batch")
    assert best.count() == 60 and stream.logged(spark, str(tmp_path / "none"), [1]) is None


def test_records_of_keys(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"card_id": i, "x": [i], "more": "y" * 50}) for i in range(20)))
    got = readers.records_of(spark, str(tmp_path / "c.jsonl"), "card_id long, x array<int>", rows(spark, [(3,), (3,), (99,)], "card_id long"), "card_id")
    assert [tuple(x) for x in got.collect()] == [(3, [3])]


GFF = "file string, row_idx long, seqid string, source string, feature string, start int, `end` int, score string, strand string, phase string, attributes string"


def test_normaliser(spark):
    line = lambda f, i, kind, a, b, attr, strand="+", phase=".", seq="c": (f, i, seq, "s", kind, a, b, ".", strand, phase, attr)
    given = [
        line("A", 0, "gene", 10, 20, "ID=g1;Name=one"), line("A", 1, "mRNA", 5, 20, "ID=t1;Parent=g1,g9"), line("A", 2, "exon", 5, 9, "Parent=t1"), line("A", 3, "CDS", 15, 40, "Parent=t1", phase="7"), line("A", 4, "CDS", 6, 9, "Parent=t1", phase="2"),
        line("A", 5, "mRNA", 100, 120, "ID=lone.t2", "."), line("A", 6, "CDS", 110, 118, "Parent=lone.t2,ghost-mRNA1", "-"), line("A", 7, "gene", 1, 2, ""), line("A", 8, "exon", 1, 2, "Note=x"), line("A", 9, "transcript", 1, 2, "Note=x"), line("A", 10, "odd", 1, 2, "ID=o"),
        line("B", 0, "transcript", 3, 4, "ID=t1;Parent=g1"), line("B", 1, "transcript", 3, 4, "ID=t1;Parent=g2"), line("B", 2, "RNA", 7, 8, "Name=only;Parent=g2"),
    ]
    df = rows(spark, given, GFF)
    genes, tx, parts = normalise.hierarchy(df)
    assert {tuple(x) for x in normalise.counts(df, genes, tx).collect()} == {("A", 4, 3, 1, 2, 2, 3, 2, 3), ("B", 2, 2, 0, 2, 0, 3, 0, 0)}
    out = normalise.features(genes, tx, parts).filter("file = 'A'").orderBy("place").collect()
    assert [(x.feature, x.start, x.end, x.strand, x.phase, x.attributes.split(";source_name")[0]) for x in out] == [
        ("gene", 1, 2, "+", ".", "ID=anonymous_gene_1;Name=anonymous_gene_1"),
        ("gene", 5, 40, "+", ".", "ID=g1;Name=one"), ("mRNA", 5, 40, "+", ".", "ID=t1;Parent=g1;Name=t1"), ("exon", 5, 9, "+", ".", "ID=t1.exon.1;Parent=t1"), ("CDS", 6, 9, "+", "2", "ID=t1.CDS.1;Parent=t1"), ("CDS", 15, 40, "+", ".", "ID=t1.CDS.2;Parent=t1"),
        ("gene", 100, 120, "-", ".", "ID=lone;Name=lone"), ("mRNA", 100, 120, "-", ".", "ID=lone.t2;Parent=lone;Name=lone.t2"), ("exon", 110, 118, "-", ".", "ID=lone.t2.exon.1;Parent=lone.t2"), ("CDS", 110, 118, "-", ".", "ID=lone.t2.CDS.1;Parent=lone.t2"),
        ("gene", 110, 118, "-", ".", "ID=ghost;Name=ghost"), ("mRNA", 110, 118, "-", ".", "ID=ghost-mRNA1;Parent=ghost;Name=ghost-mRNA1"), ("exon", 110, 118, "-", ".", "ID=ghost-mRNA1.exon.1;Parent=ghost-mRNA1"), ("CDS", 110, 118, "-", ".", "ID=ghost-mRNA1.CDS.1;Parent=ghost-mRNA1"),
    ]
    assert [x.attributes.endswith("inferred_gene=true") for x in out if x.feature == "gene"] == [False, False, True, True]


SETS = "locus_id string, pos int, set_id string, source string, model_ids array<string>, risk_tags array<string>, hard_flags array<string>, supporting_sources array<string>, equivalent_source_set_ids array<string>, gene_count int, secret string, long_read_summary struct<status:string,exact_supported_transcripts:int,partial_supported_transcripts:int,unsupported_transcripts:int,mono_exon_not_assessable_count:int,conflicting_chain_count:int,best:string>"
MODELS = "locus_id string, pos int, model_id string, source string, risk_tags array<string>, hard_flags array<string>, exon_count int, seqid string, difference struct<closest_current_model_id:string,relation:string,exon_delta:int,cds_delta:int,span_delta:int>"


def cards(spark, correction):
    sets = [
        ("L1", 0, "set_cur", "current", ["current:a:1"], ["x", "", "x"], ["not_available_for_de_novo_model"], ["ToolA", "ToolB", ""], None, 1, "ToolSecret", ("available", 2, 1, 0, 0, 0, "ToolA-chain")),
        ("L1", 1, "real_A", "ToolA", ["ToolA:g:2", "gone", "ToolA:g:1"], ["differs_from_Current"], None, ["ToolA"], ["real_A2", "real_A3"], 2, "ToolSecret", None),
        ("L1", 2, "set_B", "ToolB", [], None, None, [], None, 0, "ToolSecret", None),
    ]
    models = [("L1", 0, "current:a:1", "current", [], [], 3, "chr9", (None, "same", 0, 0, 5)), ("L1", 1, "ToolA:g:1", "ToolA", ["b", "a"], None, 2, "chr9", ("current:a:1", "other", 1, 2, 5)), ("L1", 2, "ToolA:g:2", "ToolA", None, None, 1, "chr9", None), ("L2", 0, "ToolB:z:1", "ToolB", None, None, 1, "chr9", None)]
    return {x.locus_id: x for x in public_cards.public_cards(rows(spark, sets, SETS), rows(spark, models, MODELS), correction).collect()}


def test_public_cards_name_no_source(spark):
    for correction in (True, False):
        got = cards(spark, correction)
        text = " ".join(x.card for x in got.values())
        for word in ("Tool", "real_A", "chr9", "Secret", "span", "not_available_for_de_novo_model", "gone", '"best"'):
            assert word not in text, (correction, word)
        assert got["L2"].sets == [] and json.loads(got["L2"].card)["models"][0]["exon_count"] == 1
        assert all(x.card == json.dumps(json.loads(x.card), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in got.values())


def test_public_cards_of_a_correction(spark):
    x = cards(spark, True)["L1"]
    assert [(s.set_id, s.set_role, s.candidate_label, s.model_ids, s.supporting_sources, s.representative_source, s.equivalent_source_set_ids) for s in x.sets] == [
        ("candidate_set_A", "candidate_gene_set", "candidate_A", ["candidate_model_02", "candidate_model_01"], ["source_01"], "source_01", ["equivalent_source_set_01", "equivalent_source_set_02"]),
        ("candidate_set_B", "candidate_gene_set", "candidate_B", [], [], "", []), ("current_set", "current_gene_set", "current", ["current_model_01"], ["source_01", "source_02"], "source_01", []),
    ]
    assert x.sets[0].risk_tags == ["differs_from_Current"] and x.sets[2].risk_tags == ["x"] and x.sets[2].hard_flags == []
    assert x.sets[0].long_read_summary.status == "not_configured" and x.sets[2].long_read_summary.exact_supported_transcripts == 2
    assert [(m.model_id, m.model_role, m.difference_from_current.closest_current_model_id, m.difference_from_current.relation) for m in x.models] == [("candidate_model_01", "candidate_model", "current_model_01", "other"), ("candidate_model_02", "candidate_model", "", None), ("current_model_01", "current_model", "", "same")]
    y = cards(spark, False)["L1"]
    assert [(s.set_id, s.candidate_label, s.risk_tags) for s in y.sets] == [("S01", "candidate_01", ["x"]), ("S02", "candidate_02", []), ("S03", "candidate_03", [])]
    assert "difference_from_current" not in y.card and [m.model_id for m in y.models] == ["M01", "M02", "M03"]


def test_difference_keys(spark):
    df = rows(spark, [([(1, [2]), (1, [2]), (0, [])], [(1, [2]), (3, [4])])], "a array<struct<x:int,y:array<int>>>, b array<struct<x:int,y:array<int>>>")
    d = df.select(public_cards.difference_keys(F.col("a"), F.col("b")).alias("d")).first().d
    assert [tuple(x) for x in d.only_left] == [(0, [])] and [tuple(x) for x in d.only_right] == [(3, [4])]


def test_normaliser_queries_reach_beyond_31_bits(spark, tmp_path):
    """Places of a sequence may lie beyond 2**31."""
    from locuskit.plans import public

    lines = [(k, 1, 1, n, 10.0, 1.0) for k in (9_000_003, 9_000_005, 9_000_007) for n in (1, 2)]
    rows(spark, lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows(spark, [(k, 2, "F") for k in (9_000_003, 9_000_005, 9_000_007)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    made = {x.attributes.split(";")[0]: (x.file, x.start, x.end) for x in public.k04_normalised_rows(spark, str(tmp_path)).collect()}
    assert len(made) == 9 and made["ID=x9000003.t1"] == ("ToolC", 2_250_000_061, 2_250_000_130) and made["ID=x9000005.t1.exon.2"] == ("ToolA", 2_250_001_121, 2_250_001_130)
    assert sorted((x.file, x.gene_count, x.original_exon_features) for x in public.r42_normaliser(spark, str(tmp_path)).collect()) == [("ToolA", 2, 2), ("ToolC", 1, 4)]
