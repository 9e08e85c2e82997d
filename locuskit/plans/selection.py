"""Selections, orders, lists and small rules over models, calls and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules, text
from locuskit.operators import contracts, hierarchy, lineage, tables
from locuskit.plans.cards import _K, _N, _card_sets
from locuskit.plans.registry import query
from locuskit.plans.views import table, transcripts


@query("""SELECT p_partkey, CASE WHEN st = 'fail' THEN 'fatal_qc_fail' WHEN p_size % 3 > 0 THEN NULL ELSE 'pre_ai_eligibility_fail' END AS exclusion, v <> 'fail' AND (p_size % 4 = 0 OR p_size % 5 = 0) AS supported
FROM (SELECT *, ['pass', 'fail', 'warning', ''][1 + p_partkey % 4] AS v, CASE WHEN p_size % 7 = 0 THEN 'fail' WHEN ['pass', 'fail', 'warning', ''][1 + p_partkey % 4] = '' THEN 'not_assessed' ELSE ['pass', 'fail', 'warning', ''][1 + p_partkey % 4] END AS st FROM part)""", views=False)
def f04_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models take part, why others don't, and which have support."""
    s = F.col("p_size")
    v = F.element_at(F.array(*map(F.lit, ("pass", "fail", "warning", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    fatal = F.when(s % 7 == 0, "fail").otherwise("")
    junctions = F.when(s % 4 == 0, "partial_junction_support").otherwise("none_observed")
    return table(spark, sf_dir, "part").select("p_partkey", rules.exclusion(fatal, v, s % 3 > 0).alias("exclusion"), rules.supported_model(junctions, v, F.when(s % 5 == 0, 1).otherwise(0)).alias("supported"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 1000 ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 250", views=False)
def f09_first_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cards in review order, without flagged ones (F03, F08, F09, O09, O10): a report, so its limit is the feature."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P' and o_totalprice > 1000").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(250).select("o_orderkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') EXCEPT SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 IN (1, 2)", views=False)
def f16_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with a supported member of which no row names a removed id."""
    li = table(spark, sf_dir, "lineitem")
    names = F.array(F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    removed = spark.createDataFrame([("p1",), ("p2",)], "name string")
    return tables.without_named(li, ["l_orderkey"], names, removed, "name").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag").isin("A", "R")).alias("ok")).filter("ok").select("l_orderkey")


@query("SELECT p_partkey, p_brand, k FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5, p_partkey % 5, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END, p_size % 4, p_partkey) AS k FROM part)", views=False)
def o05_model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a card by coding, junctions, proteins, source and id."""
    s, k = F.col("p_size"), F.col("p_partkey")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    order = rules.model_order(pick(("pass", "warning", "not_assessed", "missing", "fail"), s % 5), pick(("full_junction_support", "partial_junction_support", "conflicting_junction", "none_observed", "not_assessable"), k % 5), F.when(s % 3 == 0, 2).otherwise(0), s % 4, k)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(W.partitionBy("p_brand").orderBy(order)).cast("long").alias("k"))


@query("SELECT gene_id, min(s) AS start, max(e) AS \"end\", count(*) AS models, string_agg(tx_id::VARCHAR, ',' ORDER BY s, tx_id) AS txs FROM tx GROUP BY gene_id")
def a13_gene_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of proposed genes with their transcripts in order."""
    s = tables.spans(transcripts(spark, sf_dir))
    return s.select("gene_id", "start", "end", "models", F.array_join(F.col("ids").cast("array<string>"), ",").alias("txs"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN unnest(['none']) WHEN p_size % 4 = 1 THEN unnest(['internal_stop_present']) ELSE unnest(['phase_inconsistent', 'no_CDS_features']) END AS reason FROM part) GROUP BY reason".replace("CASE WHEN p_size % 4 = 0 THEN unnest(['none']) WHEN p_size % 4 = 1 THEN unnest(['internal_stop_present']) ELSE unnest(['phase_inconsistent', 'no_CDS_features']) END", "unnest(CASE WHEN p_size % 4 = 0 THEN ['none'] WHEN p_size % 4 = 1 THEN ['internal_stop_present'] ELSE ['phase_inconsistent', 'no_CDS_features'] END)"), views=False)
def a10_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason occurs; models without any count as none."""
    s, t = F.col("p_size") % 4, lambda *x: F.array(*map(F.lit, x)).cast(rules.NO_TAGS)
    reasons = F.when(s == 0, t()).when(s == 1, t("internal_stop_present")).otherwise(t("phase_inconsistent", "no_CDS_features"))
    return table(spark, sf_dir, "part").select(F.explode(F.when(F.size(reasons) == 0, t("none")).otherwise(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, count(*) AS genes, count(*) FILTER (c_acctbal < 0) AS retired, count(*) FILTER (c_mktsegment = 'BUILDING') AS replaced, count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'BUILDING') AS kept FROM customer GROUP BY c_nationkey", views=False)
def a30_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a release by species."""
    low, built = F.col("c_acctbal") < 0, F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("genes"), F.count_if(low).alias("retired"), F.count_if(built).alias("replaced"), F.count_if(~low & ~built).alias("kept"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Public_' || o_custkey ELSE 'x' || o_custkey END AS proposal, 'chr' || o_custkey % 5 || ':' || greatest(1, o_custkey - 500) || '-' || (o_custkey + 600) AS region,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '1-2,' || o_custkey END AS listed, o_orderkey % 5 = 0 AS reserved,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'novel_candidate,model_conflict' WHEN 2 THEN 'complex_structure' WHEN 3 THEN 'partial_junction_support,limited_evidence' ELSE 'workflow_flag' END AS reasons,
  '["c","+",[[' || least(o_custkey, 900) || ',' || greatest(o_custkey, 900) || ',"0"],[1000,2000,"."]]]' AS signature FROM orders""", views=False)
def p21_public_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public identifiers, browser regions, lists, reserved names, review reasons and coding signatures."""
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    listed = text.listed(F.when(o % 4 == 0, ".").otherwise(F.concat(F.lit(";1-2;.;"), c)))
    said = F.when(o % 6 == 0, "").when(o % 6 == 1, "manual%20novel_gene_candidate; CONFLICT").when(o % 6 == 2, "possible fusion").when(o % 6 == 3, "partial_junction and weak").otherwise("whatever")
    block = lambda a, b, p: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), p.alias("phase"))
    blocks = F.array(block(F.lit(1000), F.lit(2000), F.lit(None).cast("string")), block(F.lit(900), F.col("o_custkey"), F.lit("0")), block(F.lit(2000), F.lit(1000), F.lit(".")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.renamed_prefix(F.when(o % 3 == 0, F.concat(F.lit("PROP_"), c)).otherwise(F.concat(F.lit("x"), c)), "PROP_", "Public_").alias("proposal"),
        text.shown_region(F.concat(F.lit("chr"), (F.col("o_custkey") % 5).cast("string")), F.col("o_custkey"), F.col("o_custkey") + 100).alias("region"), F.size(listed).cast("long").alias("n"), F.array_join(F.slice(listed, 1, 5), ",").alias("listed"),
        text.reserved_namespace(F.when(o % 5 == 0, "abLoc").otherwise("abG")).alias("reserved"), text.review_reasons(said, F.lit(None).cast("string")).alias("reasons"), text.coding_signature(F.lit("c"), F.lit("+"), blocks).alias("signature"),
    )


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'manual_review_novel_gene_candidate' END, CASE WHEN o_orderkey % 11 = 0 THEN 'manual_review_unsupported_locus' END, CASE WHEN contains(c, 'manual_review') THEN 'manual_review_required' END,
  CASE WHEN c = 'keep_current_flagged' OR o_orderkey % 5 = 0 THEN 'risk_flagged' END, CASE WHEN o_orderstatus = 'P' THEN 'blocking_reason_present' END, CASE WHEN o_orderkey % 3 = 0 THEN 'manual_review_required_before_export' END, CASE WHEN starts_with(c, 'delete') THEN 'deletion_not_applied_by_proposal_exporter' END], lambda x: x IS NOT NULL)), ',') AS flags
FROM (SELECT *, ['keep_current', 'keep_current_flagged', 'novel_gene_candidate_manual_review', 'delete_x'][1 + o_custkey % 4] AS c FROM orders)""", views=False)
def r32_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    call = F.element_at(F.array(*map(F.lit, ("keep_current", "keep_current_flagged", "novel_gene_candidate_manual_review", "delete_x"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    flags = rules.review_flags(call, F.lit("g"), F.when(o % 5 == 0, "risk_flagged").otherwise("select_annotation_set"), F.when(o % 3 == 0, "manual_review_required_before_export").otherwise("no_change"), F.col("o_orderstatus") == "P", o % 7 == 0, F.lit(False), o % 11 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.joined(flags).alias("flags"))


_LEVEL = "CASE WHEN bool_or(lv = 3) THEN 'strong' WHEN bool_or(lv = 2) THEN 'moderate' WHEN bool_or(lv = 1) THEN 'weak' ELSE 'poor' END"


@query(_N + "," + _K + f""" e AS (SELECT *, CASE WHEN coding_qc = 'fail' THEN 0 WHEN short_read_junction = 'full' OR long_read = 'exact' THEN 3 WHEN short_read_junction = 'partial' OR long_read = 'partial' OR protein IN ('supported', 'partial') THEN 2 ELSE 1 END AS lv FROM s),
g AS (SELECT locus, count(*) AS sets, {_LEVEL} AS level, bool_or(short_read_junction = 'full') AS f, bool_or(long_read = 'exact') AS x, bool_or(short_read_junction IN ('full', 'partial') OR long_read IN ('exact', 'partial')) AS t, bool_or(protein IN ('supported', 'partial')) AS p, bool_or(coding_qc = 'fail') AS bad FROM e GROUP BY locus)
SELECT locus, level, CASE WHEN locus % 2 = 0 THEN 'not_applicable' WHEN level = 'strong' AND sets <= 1 THEN 'high' WHEN level = 'strong' THEN 'high_after_arbitration' WHEN level = 'moderate' THEN 'medium' WHEN level = 'weak' THEN 'low' ELSE 'qc_review' END AS priority,
  CASE WHEN level IN ('strong', 'moderate') THEN '' ELSE array_to_string(list_sort(list_filter(['no_listed_set_has_moderate_or_strong_biological_support', CASE WHEN NOT f THEN 'no_full_short_read_junction_support' END, CASE WHEN NOT x THEN 'no_exact_long_read_chain_support' END, CASE WHEN NOT t THEN 'no_transcript_structure_support' END, CASE WHEN NOT p THEN 'no_homolog_protein_support' END, CASE WHEN bad THEN 'one_or_more_sets_fail_coding_qc' END], lambda y: y IS NOT NULL)), ',') END AS reasons FROM g""", views=False)
def h23_unsupported_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of a locus, why it counts as unsupported, and how soon to review it."""
    e = F.col("evidence")
    level = F.when(e["coding_qc"] == "fail", 0).when((e["short_read_junction"] == "full") | (e["long_read"] == "exact"), 3).when((e["short_read_junction"] == "partial") | (e["long_read"] == "partial") | e["protein"].isin("supported", "partial"), 2).otherwise(1)
    g = _card_sets(spark, sf_dir).groupBy("locus").agg(F.count("*").alias("sets"), F.max(level).alias("k"), F.collect_list("evidence").alias("all"))
    g = g.withColumn("level", F.element_at(F.array(*map(F.lit, ("poor", "weak", "moderate", "strong"))), F.col("k") + 1))
    route = F.when(F.col("locus") % 2 == 0, "mixed_current_tool_arbitration").otherwise("tool_only_novel_gene_candidate")
    return g.select("locus", "level", rules.review_priority(route, F.col("level"), F.col("sets")).alias("priority"), rules.joined(rules.unsupported_reasons(F.col("level"), F.col("all"))).alias("reasons"))


_MODELS = """, m AS MATERIALIZED (SELECT t.tx_id, t.tx_id // 4 AS w, t.seqid, t.strand, t.source, t.s, t.e, coalesce(x, []) AS x, coalesce(c, []) AS c, coalesce(g, []) AS g, coalesce(cn, 0) AS cn FROM tx t
  LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e} ORDER BY s, e) AS x FROM exon GROUP BY tx_id) USING (tx_id) LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e} ORDER BY s, e) AS c, sum(e - s + 1)::BIGINT AS cn FROM cds GROUP BY tx_id) USING (tx_id) LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e} ORDER BY s, e) AS g FROM intron GROUP BY tx_id) USING (tx_id))
"""
_JACCARD = "CASE WHEN len(a.{0}) = 0 AND len(b.{0}) = 0 THEN 1.0 WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN 0.0 ELSE len(list_intersect(a.{0}, b.{0})) / len(list_distinct(list_concat(a.{0}, b.{0}))) END"


@query(_MODELS + f""", p AS (SELECT a.tx_id AS a, b.tx_id AS b, a.strand = b.strand AND a.strand IN ('+', '-') AS same, greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1) AS l, greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1) AS r, a.x = b.x AND a.c = b.c AS exact, len(a.g) > 0 AND a.g = b.g AS chain, len(a.g) = 0 AND len(b.g) = 0 AS none,
  {_JACCARD.format('g')} AS j, greatest({_JACCARD.format('x')}, {_JACCARD.format('c')}) AS k FROM m a JOIN m b ON a.w = b.w AND a.tx_id < b.tx_id)
SELECT a, b, CASE WHEN NOT same THEN 'different_context' WHEN l < 0.55 OR r < 0.55 THEN 'separate_or_split_merge_component' WHEN exact THEN 'exact_same_structure' WHEN chain THEN 'same_intron_chain_boundary_variant' WHEN none AND l >= 0.7 AND r >= 0.7 THEN 'single_exon_overlap_component'
  WHEN j >= 0.67 AND l >= 0.65 AND r >= 0.65 THEN 'mostly_same_splice_component' WHEN k >= 0.6 AND l >= 0.7 AND r >= 0.7 THEN 'mostly_same_coding_component' ELSE 'distinct_component_or_topology_conflict' END AS class FROM p""")
def j21_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two models of a locus are one component (J21, G03, X14, H08); a locus has few models."""
    t = transcripts(spark, sf_dir).select("tx_id", F.floor(F.col("tx_id") / 4).alias("w"), "strand", "start", "end", "blocks", "gaps", "coding")
    r = t.select("w", *[F.col(c).alias(f"{c}_r") for c in t.columns if c != "w"])
    p = t.join(r, "w").filter("tx_id < tx_id_r")
    bp = intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    alike = lambda c: F.when((F.size(c) == 0) & (F.size(f"{c}_r") == 0), 1.0).when((F.size(c) == 0) | (F.size(f"{c}_r") == 0), 0.0).otherwise(F.size(F.array_intersect(c, f"{c}_r")) / F.size(F.array_union(c, f"{c}_r")))
    same = (F.col("strand") == F.col("strand_r")) & F.col("strand").isin("+", "-")
    exact = (F.col("blocks") == F.col("blocks_r")) & (F.col("coding") == F.col("coding_r"))
    kind = rules.similarity(same, bp / (F.col("end") - F.col("start") + 1), bp / (F.col("end_r") - F.col("start_r") + 1), exact, F.col("gaps"), F.col("gaps_r"), alike("gaps"), F.greatest(alike("blocks"), alike("coding")))
    return p.select(F.col("tx_id").alias("a"), F.col("tx_id_r").alias("b"), kind.alias("class"))


@query(_MODELS + """, p AS (SELECT a.tx_id, b.tx_id AS current_id, a.s - b.s AS d0, a.e - b.e AS d1, len(a.x) - len(b.x) AS dx, len(a.g) - len(b.g) AS dg, len(a.c) - len(b.c) AS dc, a.cn - b.cn AS dl, a.x = b.x AS sx, a.g = b.g AS sg, a.c = b.c AS sc FROM m a JOIN m b ON a.w = b.w AND a.source <> 'current' AND b.source = 'current')
SELECT tx_id, current_id, d0 AS start_delta, d1 AS end_delta, dx AS exon_delta, dg AS intron_delta, dc AS coding_delta, dl AS length_delta, array_to_string(list_sort(list_filter([CASE WHEN sx THEN 'same_exon_chain' END, CASE WHEN sg THEN 'same_intron_chain' ELSE 'alternative_intron_chain' END, CASE WHEN sc THEN 'same_CDS_chain' WHEN dc = 0 THEN 'CDS_boundary_difference' WHEN dc > 0 THEN 'extra_CDS_blocks' ELSE 'fewer_CDS_blocks' END,
  CASE WHEN sg AND (d0 <> 0 OR d1 <> 0) THEN 'terminal_boundary_difference_only' END, CASE WHEN d0 <= 0 AND d1 >= 0 THEN 'candidate_contains_current_span' WHEN d0 >= 0 AND d1 <= 0 THEN 'candidate_within_current_span' END], lambda y: y IS NOT NULL)), ',') AS tags FROM p""")
def p16_to_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a model differs from the current one of its locus."""
    parts = ("start", "end", "blocks", "gaps", "coding")
    t = transcripts(spark, sf_dir).select("tx_id", F.floor(F.col("tx_id") / 4).alias("w"), "source", F.struct(*parts).alias("m"))
    p = t.filter("source <> 'current'").join(t.filter("source = 'current'").select("w", F.col("tx_id").alias("current_id"), F.col("m").alias("c")), "w")
    found, d = rules.to_current(F.col("m"), F.col("c"))
    p = p.withColumn("d", d)
    return p.select("tx_id", "current_id", F.col("d.start").alias("start_delta"), F.col("d.end").alias("end_delta"), *[F.col(f"d.{a}").cast("long").alias(b) for a, b in (("exons", "exon_delta"), ("introns", "intron_delta"), ("coding_parts", "coding_delta"))], F.col("d.coding_length").alias("length_delta"), rules.joined(found).alias("tags"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN 'numbers' WHEN k = 1 THEN 'coordinates' WHEN k = 2 THEN 'bed' WHEN k = 3 THEN 'counts' WHEN k = 4 THEN 'samples' END AS fault, l_discount > 0.05 AS bad_fraction FROM (SELECT *, (l_partkey + l_suppkey) % 8 AS k FROM lineitem)""", views=False)
def r38_evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a junction table that break its contract, and fractions outside 0 to 1."""
    k, n = (F.col("l_partkey") + F.col("l_suppkey")) % 8, F.col("l_partkey") + 1
    s = lambda c: c.cast("string")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(k == 0, "1e3").otherwise(s(n)).alias("intron_start_1based"), F.when(k == 1, s(n)).otherwise(s(n + 90)).alias("intron_end_1based"), F.when(k == 2, s(n)).otherwise(s(n - 1)).alias("bed_start_0based"),
        F.lit("").alias("bed_end_0based"), F.when(k == 3, "x").otherwise("+").alias("strand"), F.lit("3").alias("junction_read_count"), F.lit("2").alias("sample_support_count"), F.when(k == 4, "b, a").otherwise("a, b").alias("supporting_samples"),
        F.when(F.col("l_discount") > 0.05, "1.5").when(F.col("l_discount") > 0.03, "not_assessable").otherwise("0.5").alias("junction_support_fraction"),
    )
    both = contracts.fraction_faults(contracts.junction_faults(rows).withColumnRenamed("fault", "f"), ["junction_support_fraction"])
    return both.select("l_orderkey", "l_linenumber", F.col("f").alias("fault"), F.col("fault").alias("bad_fraction"))


@query("""SELECT o_orderkey, 'c' || o_custkey AS gene_id, 'T' || c.k || '.' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey::VARCHAR) AS final_id FROM orders JOIN (SELECT DISTINCT o_custkey, o_custkey AS k FROM orders) c USING (o_custkey)""".replace("'c' || o_custkey AS gene_id", "'G' || o_custkey AS gene_id"), views=False)
def g12_transcript_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript identifiers in the current style, by place within the gene."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("gene_id"), F.col("o_orderkey").cast("string").alias("tx_id"), F.col("o_totalprice").alias("start"))
    made = lineage.transcript_mapping(rows, spark.createDataFrame([], "tx_id string"), current_style=True)
    return made.select(F.col("tx_id").cast("long").alias("o_orderkey"), "gene_id", "final_id")


@query("""WITH k AS (SELECT seqid, 'A' || c_nationkey AS gene, c_custkey AS number, row_number() OVER (PARTITION BY seqid ORDER BY c_custkey % 17, c_custkey) AS o FROM (SELECT *, 's' || c_nationkey % 5 AS seqid FROM customer)),
l AS (SELECT *, number > lag(number) OVER (PARTITION BY seqid ORDER BY number % 17, number) AS up, number - lag(number) OVER (PARTITION BY seqid ORDER BY number) AS d FROM k)
SELECT seqid, count(up) AS adjacent, count(*) FILTER (up) AS rising, list_sort(list(d) FILTER (d > 0))[len(list(d) FILTER (d > 0)) // 2 + 1] AS step FROM l GROUP BY seqid""", views=False)
def a27_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers of a sequence's genes rise with their place, and by how much."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (F.col("c_nationkey") % 5).cast("string")).alias("seqid"), (F.col("c_custkey") % 17).alias("start"), F.concat(F.lit("AG"), F.col("c_custkey").cast("string")).alias("gene_id"))
    return lineage.namespaces(lineage.parsed(c)).select("seqid", "adjacent", "rising", "step")


@query("""WITH r AS (SELECT o_orderkey AS row_idx, o_orderkey % 3 = 0 AS gene, 'x' || o_custkey % 400 AS id FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_idx) AS k FROM r WHERE gene), f AS (SELECT row_idx, id, CASE WHEN k = 1 THEN id ELSE id || '.dup' || CASE WHEN k < 10 THEN '0' || k ELSE k::VARCHAR END END AS final_id FROM g)
SELECT r.row_idx, f.final_id AS final_id, CASE WHEN r.gene THEN '' ELSE coalesce(p.final_id, r.id) END AS parent FROM r LEFT JOIN f ON f.row_idx = r.row_idx ASOF LEFT JOIN f p ON p.id = r.id AND p.row_idx < r.row_idx""", views=False)
def g13_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated identifiers made unique in the order of rows, and parents that point to the last one above."""
    o = F.col("o_orderkey")
    ident = F.concat(F.lit("x"), (F.col("o_custkey") % 400).cast("string"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(o.alias("row_idx"), F.when(o % 3 == 0, "gene").otherwise("exon").alias("feature"), F.when(o % 3 == 0, ident).alias("id"), F.when(o % 3 == 0, none).otherwise(F.array(ident)).alias("parents"))
    return hierarchy.disambiguated(rows).select("row_idx", "final_id", F.array_join("final_parents", ",").alias("parent"))
