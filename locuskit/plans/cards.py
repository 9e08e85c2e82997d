"""Decision cards over sets made of lines: support, components, collapse, comparison, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import rules, text
from locuskit.operators import cards
from locuskit.plans.decisions import _COUNTS, _SCORE, _sets
from locuskit.plans.registry import query
from locuskit.plans.views import SOURCES, table
from locuskit.sources import writers

_N = _SCORE[: _SCORE.index(",\np AS (")]
_K = """ s AS (SELECT *, l_orderkey AS locus, 'S0' || l_linenumber AS set_id, ['current', 'ToolA', 'ToolB', 'ToolC'][1 + l_suppkey % 4] AS source, l_partkey % 2 AS k1, CASE WHEN l_partkey // 2 % 5 = 0 THEN 1 ELSE 0 END AS k3, l_suppkey % 2 AS k2, CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS k4,
  1 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS gene_count, 1 + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS transcript_count, CASE l_suppkey % 8 WHEN 0 THEN ['conflicting_RNA_junction', 'x_not_observed'] WHEN 1 THEN ['nearby_alternative_junctions', ''] ELSE [] END AS risks,
  CASE l_partkey % 9 WHEN 0 THEN 'misses_core_component' WHEN 1 THEN 'fusion_of_components' ELSE 'covers_core_components' END AS fit,
  CASE WHEN c_fail > 0 THEN 'fail' WHEN c_warning > 0 THEN 'warning' WHEN c_pass > 0 AND l_linenumber % 2 = 0 THEN 'pass' WHEN c_pass > 0 THEN 'partial_pass' ELSE 'not_assessed' END AS coding_qc,
  CASE WHEN c_full > 0 THEN 'full' WHEN c_partial > 0 THEN 'partial' WHEN c_conflict > 0 THEN 'conflict' WHEN c_junction_unknown > 0 AND c_none = 0 THEN 'not_assessable' WHEN c_none > 0 THEN 'not_observed' ELSE 'not_configured' END AS short_read_junction,
  CASE WHEN l_partkey % 4 = 0 THEN 'not_available' WHEN c_exact > 0 THEN 'exact' WHEN c_long_partial > 0 THEN 'partial' WHEN c_long_conflict > 0 THEN 'conflict' WHEN c_mono > 0 AND c_unsupported = 0 THEN 'not_assessable' ELSE 'not_observed' END AS long_read,
  CASE WHEN c_protein >= c_models THEN 'supported' WHEN c_protein > 0 THEN 'partial' ELSE 'not_observed' END AS protein FROM n),
"""


def _interpreted(collapsed: bool) -> str:
    support, conflict = "WHEN short_read_junction IN ('full', 'partial') OR long_read IN ('exact', 'partial') OR protein IN ('supported', 'partial') THEN 'biologically_supported'", "WHEN short_read_junction = 'conflict' OR long_read = 'conflict' THEN 'evidence_conflict'"
    return f"CASE WHEN coding_qc = 'fail' THEN 'biologically_problematic' WHEN fit IN ('misses_core_component', 'includes_unsupported_component') THEN 'topology_risk' {' '.join([support, conflict] if collapsed else [conflict, support])} ELSE 'plausible_low_evidence' END"


def _best(field: str) -> str:
    states = "[" + ", ".join(f"'{x}'" for x in rules.STATES[field]) + "]"
    return f"{states}[min(list_position({states}, {field}))] AS {field}"


_C = f""" g AS (SELECT locus, k1, k3, arg_min(set_id, CASE source WHEN 'current' THEN '0' ELSE '1' END || set_id) AS set_id, string_agg(set_id, ',' ORDER BY set_id) AS members, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, count(*) AS n, count(DISTINCT k2 * 2 + k4) AS shapes,
  {', '.join(_best(f) for f in rules.EVIDENCE)}, list_sort(list_distinct(list_filter(flatten(list(risks)), lambda x: x <> '' AND NOT contains(x, 'not_observed')))) AS risks FROM s GROUP BY locus, k1, k3),
c AS (SELECT g.*, fit, s.k2, s.k4, s.gene_count, s.transcript_count, {_interpreted(True)} AS interpretation FROM (SELECT * FROM g) g JOIN (SELECT locus, set_id, fit, k2, k4, gene_count, transcript_count FROM s) s USING (locus, set_id)),
"""


def _counts() -> dict[str, Column]:
    return {k: F.col(f"c_{k}") for k in _COUNTS} | {"long_known": F.col("l_partkey") % 4 > 0, "not_assessed": F.col("l_linenumber") % 2}


def _card_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, set_id, source, cds, introns, exons, span, counts, evidence, fit, risks."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    k1, k2, k3, k4 = (x.cast("int") for x in (part % 2, supp % 2, F.when(F.expr("l_partkey div 2") % 5 == 0, 1).otherwise(0), F.when(supp % 11 == 0, 1).otherwise(0)))
    block = lambda a, b: F.struct(F.lit(a).alias("start") if isinstance(a, int) else a.alias("start"), F.lit(b).alias("end") if isinstance(b, int) else b.alias("end"))
    tags = lambda *t: F.array(*map(F.lit, t)).cast(rules.NO_TAGS)
    return _sets(spark, sf_dir).select(
        F.col("l_orderkey").alias("locus"), F.concat(F.lit("S0"), F.col("l_linenumber").cast("string")).alias("set_id"), F.element_at(F.array(*map(F.lit, SOURCES)), (supp % 4 + 1).cast("int")).alias("source"),
        F.array(F.array(block(k1 + 10, 20), block(k3 + 30, 40), block(50, 60))).alias("cds"), F.array(F.array(block(21, k3 + 29))).alias("introns"), F.array(F.array(block(k2 + 5, 20), block(k3 + 30, k4 + 40), block(50, 70))).alias("exons"),
        F.struct((k2 + 5).alias("start"), F.lit(70).alias("end")).alias("span"), (1 + F.when(part % 13 == 0, 1).otherwise(0)).alias("gene_count"), (1 + F.when(supp % 9 == 0, 1).otherwise(0)).alias("transcript_count"),
        F.struct(*[v.alias(k) for k, v in rules.set_states(_counts()).items()]).alias("evidence"),
        F.when(part % 9 == 0, "misses_core_component").when(part % 9 == 1, "fusion_of_components").otherwise("covers_core_components").alias("fit"),
        F.when(supp % 8 == 0, tags("conflicting_RNA_junction", "x_not_observed")).when(supp % 8 == 1, tags("nearby_alternative_junctions", "")).otherwise(tags()).alias("risks"),
    )


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed sets with the structure and counts of their representatives."""
    return cards.collapse(_card_sets(spark, sf_dir), keep=("exons", "gene_count", "transcript_count"))


_PROFILE = """SELECT l_orderkey AS locus, l_linenumber AS set_no,
  CASE WHEN c_fail > 0 THEN 'fail' WHEN c_warning > 0 THEN 'warning' WHEN c_pass / c_models >= 0.95 THEN 'pass' WHEN c_pass > 0 THEN 'partial_pass' ELSE 'not_assessed' END AS coding_qc,
  CASE WHEN c_conflict > 0 THEN 'conflicting_support' WHEN c_full / c_models >= 0.95 THEN 'full_support' WHEN (c_full + c_partial) / c_models >= 0.8 THEN 'mostly_supported' WHEN c_full + c_partial > 0 THEN 'partial_support' WHEN c_junction_unknown > 0 AND c_none = 0 THEN 'not_assessable' WHEN c_none > 0 THEN 'none_observed' ELSE 'not_configured' END AS short_read_junction_support,
  CASE WHEN l_partkey % 4 = 0 THEN 'not_configured' WHEN c_long_conflict > 0 THEN 'conflicting_chains_present' WHEN c_exact / c_models >= 0.8 THEN 'exact_chain_support' WHEN (c_exact + c_long_partial) / c_models >= 0.8 THEN 'mostly_supported' WHEN c_exact + c_long_partial > 0 THEN 'partial_support'
    WHEN c_mono > 0 AND c_unsupported = 0 THEN 'not_assessable_mono_exon' WHEN c_unsupported > 0 THEN 'unsupported' ELSE 'available_no_support' END AS long_read_transcriptome_support,
  CASE WHEN c_protein / c_models >= 0.8 THEN 'supported' WHEN c_protein > 0 THEN 'partially_supported' ELSE 'not_observed' END AS protein_support,
  CASE WHEN l_partkey % 3 = 0 THEN 'present' ELSE 'not_detected' END AS candidate_generation_agreement, CASE WHEN l_partkey % 3 = 0 THEN 'candidate_generation_agreement_only' ELSE 'not_detected' END AS cross_candidate_consistency,
  CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low_to_moderate' ELSE 'low' END AS risk_level FROM n"""


@query(_N + _PROFILE, views=False)
def r12_support_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array(F.when(F.col("l_suppkey") % 3 == 0, "long_read_conflicting_chain").when(F.col("l_suppkey") % 3 == 1, "limited_short_read").otherwise("fine"))
    made = rules.support_profile(_counts(), shared=F.col("l_partkey") % 3 == 0, flags=flags)
    return _sets(spark, sf_dir).select(F.col("l_orderkey").alias("locus"), F.col("l_linenumber").alias("set_no"), *[v.alias(k) for k, v in made.items()])


_WORDS = """SELECT p_partkey, CASE WHEN x THEN 'possible_extra_or_mono_exon_component' WHEN mono THEN 'mono_exon_protein_coding_component' ELSE 'protein_coding_transcript_component' END AS component_type,
  CASE WHEN x THEN 'possible extra mono-exon gene or candidate-specific coding unit' WHEN m = 4 THEN 'shared supported protein-coding transcript component' WHEN m > 1 THEN 'supported coding component shared by a subset of candidate sets' ELSE 'candidate-specific protein-coding component' END AS claim,
  CASE WHEN x THEN 'uncertain_extra_component' WHEN m = 4 THEN 'shared_core_component' WHEN p_size % 5 = 0 THEN 'strong_component' ELSE 'candidate_specific_component' END AS role,
  CASE WHEN x THEN 'mono_exon_or_extra_gene_status' WHEN m = 4 THEN 'terminal_boundary_or_transcript_span' ELSE 'split_merge_or_component_presence' END AS uncertainty
FROM (SELECT p_partkey, p_size, p_size % 3 = 0 AS mono, 1 + p_size % 4 AS m, p_size % 3 = 0 AND p_size % 4 < 3 AS x FROM part)"""


@query(_WORDS, views=False)
def r14_component_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    made = rules.component_words(s % 3 == 0, 1 + s % 4, F.lit(4), F.when(s % 5 == 0, "high").otherwise("low"))
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in made.items()])


#: Which components a set has, and in which state; roles and tiers of a locus's components.
_MAP = """WITH m AS (SELECT l_orderkey AS locus, l_linenumber AS set_id, 'C' || (l_suppkey % 4) AS component, min(['not_included', 'covered_within_same_gene', 'covered_as_independent_gene', 'covered_as_extra_mono_exon_gene', 'covered'][1 + l_partkey % 5]) AS state FROM lineitem GROUP BY ALL),
r AS (SELECT locus, component, CASE (locus + ascii(component[2])) % 4 WHEN 0 THEN 'shared_core_component' WHEN 1 THEN 'strong_component' WHEN 2 THEN 'uncertain_extra_component' ELSE 'candidate_specific_component' END AS role, CASE WHEN locus % 3 = 0 THEN 'high' ELSE 'low' END AS tier FROM (SELECT DISTINCT locus, component FROM m)),
e AS (SELECT q.locus, q.set_id, r.component, role, tier, coalesce(state, 'not_included') AS state FROM (SELECT DISTINCT locus, set_id FROM m) q JOIN r USING (locus) LEFT JOIN m ON m.locus = q.locus AND m.set_id = q.set_id AND m.component = r.component),
f AS (SELECT locus, set_id, list(component ORDER BY component) FILTER (role IN ('shared_core_component', 'strong_component') AND state <> 'not_included') AS strong_covered, list(component ORDER BY component) FILTER (role IN ('shared_core_component', 'strong_component') AND state = 'not_included') AS strong_missing,
  list(component ORDER BY component) FILTER (role = 'uncertain_extra_component' AND state <> 'not_included') AS uncertain_included, list(component ORDER BY component) FILTER (role = 'candidate_specific_component' AND tier = 'low' AND state <> 'not_included') AS unsupported_included, bool_or(state = 'covered_within_same_gene') AS fused FROM e GROUP BY ALL)
"""


def _mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states = F.array(*map(F.lit, ("not_included", "covered_within_same_gene", "covered_as_independent_gene", "covered_as_extra_mono_exon_gene", "covered")))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("locus"), F.col("l_linenumber").alias("set_id"), F.concat(F.lit("C"), (F.col("l_suppkey") % 4).cast("string")).alias("component")).agg(F.min(F.element_at(states, (F.col("l_partkey") % 5 + 1).cast("int"))).alias("state"))
    k = (F.col("locus") + F.ascii(F.substring("component", 2, 1))) % 4
    role = F.when(k == 0, "shared_core_component").when(k == 1, "strong_component").when(k == 2, "uncertain_extra_component").otherwise("candidate_specific_component")
    return m, m.select("locus", "component").distinct().select("locus", "component", role.alias("role"), F.when(F.col("locus") % 3 == 0, "high").otherwise("low").alias("tier"))


_FIT = """SELECT locus, set_id, coalesce(array_to_string(strong_covered, ','), '') AS strong_covered, coalesce(array_to_string(strong_missing, ','), '') AS strong_missing, coalesce(array_to_string(uncertain_included, ','), '') AS uncertain_included, coalesce(array_to_string(unsupported_included, ','), '') AS unsupported_included,
  CASE WHEN strong_missing IS NOT NULL THEN 'misses_core_component' WHEN uncertain_included IS NOT NULL THEN 'includes_uncertain_extra_component' WHEN unsupported_included IS NOT NULL THEN 'includes_unsupported_component' WHEN fused THEN 'fusion_of_components' ELSE 'covers_core_components' END AS fit,
  CASE WHEN fused OR locus % 7 = 0 THEN 'possible' ELSE 'none' END AS fusion_risk, CASE WHEN locus % 5 = 0 THEN 'possible' ELSE 'none' END AS split_risk, CASE WHEN uncertain_included IS NOT NULL THEN 'possible' ELSE 'none' END AS extra_gene_risk, CASE WHEN strong_missing IS NOT NULL THEN 'possible' ELSE 'none' END AS missing_component_risk FROM f"""


@query(_MAP + _FIT, views=False)
def r15_component_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which components a set covers, misses or has beyond them, and what that risks."""
    fit = cards.component_fit(*_mapping(spark, sf_dir))
    lists = ("strong_covered", "strong_missing", "uncertain_included", "unsupported_included")
    claim = F.when(F.col("locus") % 5 == 0, "independent_genes_of_two").otherwise("one_gene")
    risks = F.when(F.col("locus") % 7 == 0, F.array(F.lit("possible_fusion_if_components_are_independent"))).otherwise(F.array().cast(rules.NO_TAGS))
    made = rules.topology_risks(claim, F.col("fused"), F.col("strong_missing"), F.col("uncertain_included"), risks)
    return fit.select("locus", "set_id", *[rules.joined(F.col(c)).alias(c) for c in lists], "fit", *[v.alias(k) for k, v in made.items()])


_STATE = """CASE WHEN len(p) = 0 THEN 'absent' WHEN len(p) > 1 THEN 'mixed' WHEN p[1] = 'covered_within_same_gene' THEN 'present_as_fused_component' WHEN p[1] = 'covered_as_independent_gene' THEN 'present_as_independent_gene' WHEN p[1] = 'covered_as_extra_mono_exon_gene' THEN 'present_as_uncertain_extra' ELSE 'present' END"""


@query(_MAP + f""", x AS (SELECT locus, set_id % 2 AS set_id, component, {_STATE} AS state FROM (SELECT locus, set_id, component, list_distinct(list(state) FILTER (state <> 'not_included')) AS p FROM (SELECT locus, set_id % 2 AS set_id, component, state FROM e) GROUP BY ALL) y(locus, set_id, component, p))
SELECT *, count(DISTINCT state) OVER (PARTITION BY locus, component) > 1 AS variable FROM x""".replace("list_distinct(list(state) FILTER (state <> 'not_included'))", "coalesce(list_distinct(list(state) FILTER (state <> 'not_included')), [])"), views=False)
def a23_component_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of components over collapsed sets, and which components vary."""
    m, _ = _mapping(spark, sf_dir)
    members = m.select("locus", (F.col("set_id") % 2).alias("set_id"), F.col("set_id").alias("member")).distinct()
    return cards.component_states(m, members)


@query(_MAP + """, t AS (SELECT locus, set_id, coalesce(len(strong_missing), 0) AS missing, coalesce(len(uncertain_included), 0) + coalesce(len(unsupported_included), 0) AS extra, locus % 11 = 0 AS bad, CASE set_id % 3 WHEN 0 THEN 'splice' WHEN 1 THEN 'protein_only' ELSE 'none' END AS support, fused FROM f),
w AS (SELECT *, list_filter([CASE WHEN bad THEN 'coding_qc_fail' END, CASE WHEN missing > 0 THEN 'missing_strong_component' END, CASE WHEN extra > 0 AND support <> 'splice' THEN 'unsupported_extra_component' END, CASE WHEN fused AND support <> 'splice' THEN 'unsupported_split_or_fusion_topology' END], lambda x: x IS NOT NULL) AS r FROM t)
SELECT locus, set_id, CASE WHEN len(r) = 0 THEN 'normal' ELSE CASE r[1] WHEN 'coding_qc_fail' THEN 'low_priority_coding_problem' WHEN 'missing_strong_component' THEN 'low_priority_missing_strong_component' WHEN 'unsupported_extra_component' THEN 'low_priority_extra_component' ELSE 'low_priority_unsupported_split_or_fusion' END END AS priority, array_to_string(list_sort(r), ',') AS reasons FROM w""", views=False)
def r19_component_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a set is set back by its components."""
    f = cards.component_fit(*_mapping(spark, sf_dir))
    k = F.col("set_id") % 3
    support = rules.direct_support(k == 0, F.lit(False), k == 1)
    priority, reasons = rules.component_priority(F.col("locus") % 11 == 0, F.size("strong_missing"), F.size("uncertain_included") + F.size("unsupported_included"), support, F.col("fused"), support)
    return f.select("locus", "set_id", priority.alias("priority"), rules.joined(reasons).alias("reasons"))


@query(_N + "," + _K.rstrip().rstrip(",") + f" SELECT locus, set_id, coding_qc, short_read_junction, long_read, protein, {_interpreted(False)} AS alone, {_interpreted(True)} AS collapsed FROM s", views=False)
def r18_set_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of evidence of a set, and what it is by either order of conflict and support."""
    return _card_sets(spark, sf_dir).select("locus", "set_id", "evidence.*", rules.interpretation(F.col("evidence"), F.col("fit"), False).alias("alone"), rules.interpretation(F.col("evidence"), F.col("fit"), True).alias("collapsed"))


@query(_N + "," + _K + _C.rstrip().rstrip(",") + """ SELECT locus, set_id, members, sources, CASE WHEN n = 1 THEN 'single_set' WHEN shapes = 1 THEN 'CDS_intron_exon_identical' ELSE 'CDS_intron_identical_UTR_or_span_differs' END AS scope, CASE WHEN n > 1 AND shapes > 1 THEN 'UTR_or_transcript_span' ELSE 'none' END AS difference,
  coding_qc, short_read_junction, long_read, protein, array_to_string(risks, ',') AS risks, interpretation FROM c""", views=False)
def r17_set_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of equal coding parts and introns as one, with the best state of each kind of evidence."""
    c = _collapsed(spark, sf_dir)
    return c.select("locus", "set_id", rules.joined(F.col("members")).alias("members"), rules.joined(F.col("sources")).alias("sources"), "scope", "difference", "evidence.*", rules.joined(F.array_sort("risks")).alias("risks"), "interpretation")


_D = """ d AS (SELECT locus, count(*) AS sets, CASE WHEN count(DISTINCT k1 * 2 + k3) <= 1 THEN 'identical' WHEN count(DISTINCT k3) = 1 THEN 'terminal_only_difference' ELSE 'different' END AS cds, CASE WHEN count(DISTINCT k3) <= 1 THEN 'identical' ELSE 'different' END AS intron_chain,
  CASE WHEN count(DISTINCT (k2, k3, k4)) <= 1 THEN 'identical' WHEN count(DISTINCT (k3, k4)) = 1 THEN 'terminal_only_difference' ELSE 'different' END AS exon_structure, CASE WHEN count(DISTINCT gene_count) <= 1 THEN 'same' ELSE 'different' END AS gene_count, CASE WHEN count(DISTINCT transcript_count) <= 1 THEN 'same' ELSE 'different' END AS transcript_count, locus % 10 = 1 AS variable,
  list_filter([CASE WHEN count(DISTINCT coding_qc) > 1 THEN 'coding_qc' END, CASE WHEN count(DISTINCT short_read_junction) > 1 THEN 'short_read_junction' END, CASE WHEN count(DISTINCT long_read) > 1 THEN 'long_read' END, CASE WHEN count(DISTINCT protein) > 1 THEN 'protein' END], lambda x: x IS NOT NULL) AS differing,
  list_filter([CASE WHEN count(DISTINCT coding_qc) = 1 THEN 'coding_qc=' || min(coding_qc) END, CASE WHEN count(DISTINCT short_read_junction) = 1 THEN 'short_read_junction=' || min(short_read_junction) END, CASE WHEN count(DISTINCT long_read) = 1 THEN 'long_read=' || min(long_read) END, CASE WHEN count(DISTINCT protein) = 1 THEN 'protein=' || min(protein) END], lambda x: x IS NOT NULL) AS shared FROM c GROUP BY locus),
o AS (SELECT *, CASE WHEN sets <= 1 THEN 'single_set' WHEN variable OR gene_count = 'different' THEN 'split_merge_or_gene_count_difference' WHEN intron_chain = 'different' THEN 'intron_chain_difference' WHEN cds = 'different' OR exon_structure = 'different' THEN 'internal_exon_or_CDS_difference'
  WHEN cds = 'terminal_only_difference' OR exon_structure = 'terminal_only_difference' THEN 'terminal_boundary_only' ELSE 'no_visible_structure_difference_after_collapse' END AS overall FROM d),
"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collapsed(spark, sf_dir)
    variable = c.filter("locus % 10 = 1").select("locus")
    return cards.structure_differences(c, variable).join(cards.evidence_differences(c), "locus")


@query(_N + "," + _K + _C + _D.rstrip().rstrip(",") + """ SELECT locus, cds, intron_chain, exon_structure, gene_count, transcript_count, overall, CASE WHEN overall IN ('split_merge_or_gene_count_difference', 'intron_chain_difference') THEN 'high' WHEN overall = 'internal_exon_or_CDS_difference' THEN 'medium' ELSE 'low' END AS relevance, array_to_string(shared, ',') AS shared, array_to_string(differing, ',') AS differing FROM o""", views=False)
def r21_structure_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sets of a locus differ, in structure and in evidence."""
    return _differences(spark, sf_dir).select("locus", "cds", "intron_chain", "exon_structure", "gene_count", "transcript_count", "overall", "relevance", rules.joined(F.col("shared")).alias("shared"), rules.joined(F.col("differing")).alias("differing"))


_FOCUS = """CASE overall WHEN 'split_merge_or_gene_count_difference' THEN 'Compare component topology: independent genes versus fused, extra, or missing components.' || more WHEN 'intron_chain_difference' THEN 'Compare alternative intron chains using transcript junction and long-read chain evidence.' || more
  WHEN 'internal_exon_or_CDS_difference' THEN 'Compare internal CDS/exon structure using coding QC, transcript support, and protein support.' || more WHEN 'terminal_boundary_only' THEN 'Candidate sets mainly differ at terminal CDS/exon boundaries; listed evidence may not distinguish them.' || more
  WHEN 'single_set' THEN 'Only one annotation set remains after deterministic collapse.' ELSE 'Select the listed annotation set best supported by coding QC, transcript evidence, protein evidence, and component topology.' END"""


@query(_N + "," + _K + _C + _D + f""" w AS (SELECT *, CASE WHEN len(differing) > 0 THEN ' Evidence differs in: ' || array_to_string(list_sort(differing), ', ') || '.' ELSE '' END AS more FROM o)
SELECT locus, CASE WHEN sets <= 1 THEN 'single_set' WHEN locus % 6 = 0 OR overall = 'split_merge_or_gene_count_difference' THEN 'split_merge_or_component_topology' WHEN variable THEN 'component_presence_difference' WHEN overall IN ('intron_chain_difference', 'internal_exon_or_CDS_difference', 'terminal_boundary_only') THEN overall
  WHEN len(differing) > 0 THEN 'evidence_difference_between_structures' ELSE 'CDS_or_intron_structure_difference_without_visible_evidence_discriminator' END AS class, {_FOCUS} AS focus,
  CASE overall WHEN 'split_merge_or_gene_count_difference' THEN 'component_topology_or_gene_count' WHEN 'intron_chain_difference' THEN 'which_intron_chain_is_best_supported' WHEN 'internal_exon_or_CDS_difference' THEN 'which_internal_CDS_or_exon_structure_is_best_supported' WHEN 'terminal_boundary_only' THEN 'terminal_boundary_tie_break'
  ELSE 'which listed annotation set is best supported' END AS question FROM w""", views=False)
def r22_decision_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _differences(spark, sf_dir)
    kind = rules.difference_class(F.col("sets"), F.col("locus") % 6 == 0, F.col("variable"), F.col("overall"), F.size("differing") > 0)
    return d.select("locus", kind.alias("class"), rules.decision_focus(F.col("overall"), F.col("differing")).alias("focus"), rules.main_question(F.col("overall"), F.lit(None).cast("string")).alias("question"))


_Q = """ q AS (SELECT *, CASE WHEN priority <> 'normal' THEN least(1, r) ELSE r END AS v FROM (SELECT locus, set_id, CASE interpretation WHEN 'biologically_supported' THEN 4 WHEN 'evidence_conflict' THEN 2 WHEN 'plausible_low_evidence' THEN 1 ELSE 0 END AS r, CASE WHEN list_contains(risks, 'nearby_alternative_junctions') THEN 'low_priority_extra_component' ELSE 'normal' END AS priority FROM c)),
b AS (SELECT locus, count(*) AS n, max(v) AS best, arg_min(set_id, lpad((9 - v)::VARCHAR, 2, '0') || set_id) AS recommended FROM q GROUP BY locus),
h AS (SELECT b.*, locus % 6 = 0 AS split, (SELECT count(*) FROM q WHERE q.locus = b.locus AND q.v = b.best) AS first FROM b),
m AS (SELECT locus, CASE WHEN best <= 1 AND split AND n > 1 THEN 'conflicting' WHEN n = 1 THEN 'none' WHEN first = 1 AND best >= 3 THEN 'clear' ELSE 'weak' END AS discriminator_status, CASE WHEN split THEN 'split_merge' ELSE 'none' END AS main_conflict,
  CASE WHEN best <= 1 AND split AND n > 1 THEN 'risk_if_unresolved_conflict' ELSE 'select_best_listed_set' END AS recommended_default, recommended AS recommended_set_id FROM h),
"""


def _comparison(collapsed: DataFrame) -> DataFrame:
    priority = F.when(F.array_contains("risks", "nearby_alternative_junctions"), "low_priority_extra_component").otherwise("normal")
    return cards.comparison(collapsed.withColumns({"priority": priority, "split_merge": F.col("locus") % 6 == 0}))


@query(_N + "," + _K + _C + _Q.rstrip().rstrip(",") + " SELECT * FROM m", views=False)
def r20_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the evidence tells the sets of a locus apart, and which one it favours."""
    return _comparison(_collapsed(spark, sf_dir))


_GATES = """ z AS (SELECT c.*, short_read_junction = 'full' OR long_read = 'exact' AS strong, list_contains(risks, 'conflicting_RNA_junction') AS risky FROM c),
y AS (SELECT *, fit = 'covers_core_components' AND interpretation = 'biologically_supported' AND coding_qc = 'pass' AND strong AS fine FROM z),
a AS (SELECT locus, (SELECT count(DISTINCT source) FROM s WHERE s.locus = y.locus) AS all_sources, count(*) AS n, count(DISTINCT (fit, interpretation, coding_qc, short_read_junction, long_read, protein, risks)) AS looks, arg_min(set_id, CASE WHEN contains(sources, 'current') THEN '0' ELSE '1' END || set_id) AS first, count(*) FILTER (fine) AS rivals FROM y GROUP BY locus),
t AS (SELECT a.*, o.overall, o.intron_chain, o.gene_count, o.transcript_count, o.variable, len(o.differing) AS differing, m.main_conflict FROM a JOIN o USING (locus) JOIN m USING (locus)),
u AS (SELECT y.locus, count(*) AS able, min(set_id) AS set_id FROM y JOIN a USING (locus) WHERE fine AND NOT risky AND 2 * n_sources > all_sources GROUP BY y.locus),
v AS (SELECT t.*, u.set_id AS best, CASE WHEN n = 1 THEN 'Gate_A_single_set_after_CDS_intron_collapse' WHEN overall = 'terminal_boundary_only' AND intron_chain = 'identical' AND gene_count = 'same' AND transcript_count = 'same' AND NOT variable AND differing = 0 AND looks = 1 THEN 'Gate_C_terminal_boundary_equivalent'
  WHEN main_conflict = 'none' AND t.locus % 4 <> 0 AND all_sources >= 3 AND coalesce(able, 0) = 1 AND rivals = 1 THEN 'Gate_B_dominant_supported_set' END AS gate FROM t LEFT JOIN u USING (locus)),
x AS (SELECT v.locus, gate, y.set_id, y.interpretation, y.risks, y.risky, y.n_sources, all_sources FROM v JOIN y ON y.locus = v.locus AND y.set_id = CASE gate[1:6] WHEN 'Gate_B' THEN best ELSE first END WHERE gate IS NOT NULL),
l AS (SELECT *, CASE WHEN risky THEN 'high' WHEN interpretation = 'biologically_supported' THEN CASE WHEN len(risks) > 0 THEN 'low_to_moderate' ELSE 'low' END WHEN interpretation IN ('plausible_low_evidence', 'evidence_conflict') THEN 'moderate' ELSE 'high' END AS risk_level FROM x)
SELECT locus, gate, set_id, CASE gate[1:6] WHEN 'Gate_B' THEN 'high' WHEN 'Gate_C' THEN 'medium' ELSE CASE risk_level WHEN 'low' THEN 'high' WHEN 'high' THEN 'low' ELSE 'medium' END END AS confidence, risk_level,
  array_to_string(list_sort(list_filter([CASE interpretation WHEN 'biologically_supported' THEN 'selected_set_has_direct_biological_support' WHEN 'plausible_low_evidence' THEN 'single_selected_set_has_limited_direct_evidence' WHEN 'evidence_conflict' THEN 'selected_set_has_conflicting_evidence' ELSE 'selected_set_has_topology_or_coding_risk' END,
    CASE WHEN risky THEN 'strong_risk_tag_present' WHEN len(risks) > 0 THEN 'nonblocking_risk_tags_present' END, CASE gate[1:6] WHEN 'Gate_A' THEN 'no_alternative_CDS_intron_set_after_collapse' WHEN 'Gate_B' THEN 'dominant_supported_set_passed_strict_gate' ELSE 'terminal_boundary_only_without_visible_evidence_discriminator' END], lambda x: x IS NOT NULL)), ',') AS risk_reasons,
  CASE WHEN gate[1:6] = 'Gate_B' THEN n_sources END::BIGINT AS dominant_sources, CASE WHEN gate[1:6] = 'Gate_B' THEN all_sources END::BIGINT AS all_sources FROM l"""


@query(_N + "," + _K + _C + _D + _Q + _GATES, views=False)
def r23_card_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gates A, C and B decide without a decision step, in this order, and with which risk."""
    c = _collapsed(spark, sf_dir).withColumn("topology_claim", F.lit("one_gene"))
    differences = _differences(spark, sf_dir).join(_comparison(c).select("locus", "main_conflict"), "locus").withColumn("possible_split_merge", F.col("locus") % 4 == 0)
    g = cards.auto_gates(c, differences)
    return g.select("locus", "gate", "set_id", "confidence", "risk_level", rules.joined(F.col("risk_reasons")).alias("risk_reasons"), F.col("dominant_sources").cast("long").alias("dominant_sources"), F.col("all_sources").cast("long").alias("all_sources"))


@query("""WITH l AS (SELECT l_orderkey AS locus, count(*) FILTER (l_quantity > 48) > 0 AS hard, max(l_quantity) > 40 AS complex, count(DISTINCT l_partkey % 3) FILTER (l_suppkey % 3 = 0 OR l_suppkey % 5 = 0) AS supported, list_distinct(list(l_partkey % 3) FILTER (l_suppkey % 3 = 0)) AS rna, list_distinct(list(l_partkey % 3) FILTER (l_suppkey % 5 = 0)) AS protein, bool_or(l_discount > 0.09) AS bad FROM lineitem GROUP BY ALL),
x AS (SELECT *, rna IS NOT NULL AND protein IS NOT NULL AND NOT list_has_any(rna, protein) AS disjoint FROM l),
t AS (SELECT *, list_sort(list_filter([CASE WHEN complex THEN 'many_candidate_models_AI_arbitrable' END, CASE WHEN supported > 1 THEN 'multiple_supported_distinct_structures' END, CASE WHEN disjoint THEN 'RNA_protein_support_different_structures' END, CASE WHEN bad THEN 'one_or_more_candidate_validation_fail' END], lambda y: y IS NOT NULL)) AS triggers FROM x)
SELECT locus, hard AS risk_flagged, CASE WHEN hard THEN 'window_span_above_hard_limit_for_AI' ELSE array_to_string(triggers, ',') END AS risk_triggers, NOT hard AS decision_required,
  CASE WHEN hard THEN 'risk_flagged_no_ai_decision' WHEN len(triggers) > 0 THEN 'AI_must_select_best_gene_set_with_complexity_or_conflict_flags' ELSE 'AI_must_select_one_best_gene_set_id' END AS decision_requirement, CASE WHEN hard THEN 'risk_flagged' ELSE 'keep_current_set,choose_candidate_set' END AS recommended_action_space,
  CASE WHEN disjoint THEN 'RNA_protein_conflict' WHEN supported > 1 THEN 'supported_model_conflict' WHEN complex THEN 'complex_locus' WHEN bad THEN 'validation_conflict' ELSE 'none' END AS conflict_class,
  CASE WHEN hard THEN 'risk_review_after_pipeline' WHEN len(triggers) > 0 THEN 'AI_gene_set_arbitration_with_complexity_flags_then_set_validation' ELSE 'AI_gene_set_arbitration_then_set_validation' END AS recommended_next_gate FROM t""", views=False)
def r10_risk_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a locus goes to a decision, and with which flags."""
    rna, protein, shape = F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 5 == 0, F.col("l_partkey") % 3
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("locus")).agg(
        (F.count_if(F.col("l_quantity") > 48) > 0).alias("hard"), (F.max("l_quantity") > 40).alias("complex"), F.count_distinct(F.when(rna | protein, shape)).alias("supported"),
        F.collect_set(F.when(rna, shape)).alias("rna"), F.collect_set(F.when(protein, shape)).alias("protein"), F.bool_or(F.col("l_discount") > 0.09).alias("bad"),
    )
    one = lambda c, t: F.when(F.col(c), F.array(F.lit(t))).otherwise(F.array().cast(rules.NO_TAGS))
    disjoint = (F.size("rna") > 0) & (F.size("protein") > 0) & ~F.arrays_overlap("rna", "protein")
    made = rules.risk_router(one("complex", "many_candidate_models_AI_arbitrable"), one("hard", "window_span_above_hard_limit_for_AI"), F.col("supported"), disjoint, F.col("bad"))
    return g.select("locus", *[v.alias(k) for k, v in made.items()])


_CLASSES = ("exact_chain_supported", "single_read_exact_chain", "all_junctions_supported_no_exact_chain", "partial_junction_supported", "unsupported_by_long_reads", "mono_exon_not_assessable", "")
_STATUS = ("available", "not_configured", "not_available_for_source", "missing_for_model")
_LISTED = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _pick(xs: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))


@query(f"""WITH m AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN {_LISTED(_STATUS)}[1 + p_partkey % 4] ELSE 'available' END AS st, {_LISTED(_CLASSES)}[1 + p_partkey % 7] AS c, CASE p_size % 3 WHEN 0 THEN ['low_depth'] WHEN 1 THEN ['a', 'low_depth'] ELSE [] END AS r,
  {_LISTED(("direct_current_summary_available", "missing_for_current_model", "not_available_for_de_novo_model", "not_configured"))}[1 + p_partkey % 4] AS js, p_size % 5 / 4.0 AS f, p_size % 7 = 0 AS whole FROM part),
x AS (SELECT *, st = 'available' AS v FROM m)
SELECT p_partkey, coalesce(CASE WHEN v THEN CASE c WHEN 'exact_chain_supported' THEN 'long_read_exact_chain_supported' WHEN 'single_read_exact_chain' THEN 'long_read_single_read_exact_chain' WHEN 'all_junctions_supported_no_exact_chain' THEN 'long_read_all_junctions_supported_no_exact_chain' WHEN 'partial_junction_supported' THEN 'long_read_partial_junction_supported' END END, '') AS long_flags,
  array_to_string(list_sort(list_distinct(list_concat(list_filter([CASE st WHEN 'not_available_for_source' THEN 'long_read_not_available_for_source' WHEN 'missing_for_model' THEN 'long_read_missing_for_model' END,
    CASE WHEN v THEN CASE c WHEN 'single_read_exact_chain' THEN 'long_read_single_read_exact_chain' WHEN 'all_junctions_supported_no_exact_chain' THEN 'long_read_no_exact_chain' WHEN 'partial_junction_supported' THEN 'long_read_partial_junction_supported' WHEN 'unsupported_by_long_reads' THEN 'long_read_unsupported_by_long_reads' WHEN 'mono_exon_not_assessable' THEN 'long_read_mono_exon_not_assessable' END END], lambda y: y IS NOT NULL),
    CASE WHEN v THEN list_transform(r, lambda y: 'long_read_' || y) ELSE [] END))), ',') AS long_risks,
  CASE WHEN js = 'direct_current_summary_available' AND whole THEN 'model_level_full_intron_chain_supported' WHEN js = 'direct_current_summary_available' AND f > 0 AND f < 1 THEN 'model_level_partial_junction_support' ELSE '' END AS own_flags,
  CASE WHEN js IN ('missing_for_current_model', 'not_available_for_de_novo_model') THEN js WHEN js <> 'direct_current_summary_available' OR whole THEN '' WHEN f = 0 THEN 'model_level_no_junction_support' WHEN f < 1 THEN 'model_level_partial_junction_support' ELSE '' END AS own_risks FROM x""", views=False)
def r07_evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and risk tags that long reads and a model's own junction summary add."""
    k, s = F.col("p_partkey"), F.col("p_size")
    tags = lambda *t: F.array(*map(F.lit, t)).cast(rules.NO_TAGS)
    status = F.when(s % 9 == 0, _pick(_STATUS, k % 4)).otherwise("available")
    flags, risks = rules.long_read_flags(status, _pick(_CLASSES, k % 7), F.when(s % 3 == 0, tags("low_depth")).when(s % 3 == 1, tags("a", "low_depth")).otherwise(tags()))
    own = _pick(("direct_current_summary_available", "missing_for_current_model", "not_available_for_de_novo_model", "not_configured"), k % 4)
    own_flags, own_risks = rules.junction_summary_flags(own, s % 5 / 4.0, s % 7 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", *[rules.joined(c).alias(n) for c, n in ((flags, "long_flags"), (risks, "long_risks"), (own_flags, "own_flags"), (own_risks, "own_risks"))])


@query(f"""WITH m AS (SELECT l_orderkey AS locus, l_returnflag AS source, 'g' || (l_suppkey % 50) AS gene_id, CASE l_returnflag WHEN 'A' THEN 'not_configured' WHEN 'R' THEN CASE WHEN l_partkey % 2 = 0 THEN 'available' ELSE 'missing_for_model' END ELSE 'not_available_for_source' END AS st0, l_partkey, {_LISTED(_CLASSES)}[1 + l_partkey % 7] AS c, l_linenumber % 2 AS conflicts, l_orderkey % 2 = 0 AS odd FROM lineitem),
n AS (SELECT *, CASE WHEN odd AND st0 = 'not_available_for_source' THEN 'available' ELSE st0 END AS st FROM m),
g AS (SELECT 'R' AS source, 'g' || i AS gene_id, CASE WHEN i % 4 = 0 THEN 'mono_exon_not_assessable' ELSE 'some' END AS level, i % 3 AS exact, i % 2 AS partial, i % 5 AS unsupported, i % 2 AS conflicts FROM range(0, 50, 3) t(i)),
a AS (SELECT locus, source, bool_and(st = 'not_configured') AS off, bool_and(st = 'not_available_for_source') AS away, bool_or(st = 'available') AS have, count(*) FILTER (c IN ('exact_chain_supported', 'single_read_exact_chain')) AS me, count(*) FILTER (c IN ('all_junctions_supported_no_exact_chain', 'partial_junction_supported')) AS mp, count(*) FILTER (c = 'unsupported_by_long_reads') AS mu, count(*) FILTER (c = 'mono_exon_not_assessable') AS mm, sum(conflicts) AS mc FROM n GROUP BY ALL),
o AS (SELECT locus, source, count(*) AS k, sum(exact) AS ge, sum(partial) AS gp, sum(unsupported) AS gu, sum(conflicts) AS gc, count(*) FILTER (level = 'mono_exon_not_assessable') AS gm, list_sort(list_distinct(list('b' || gene_id))) AS best FROM (SELECT DISTINCT locus, source, gene_id FROM n) JOIN g USING (source, gene_id) GROUP BY ALL),
j AS (SELECT a.*, coalesce(k, 0) AS k, ge, gp, gu, gc, gm, best, NOT off AND NOT away AS live FROM a LEFT JOIN o USING (locus, source))
SELECT locus, source, CASE WHEN off THEN 'not_configured' WHEN away THEN 'not_available_for_source' WHEN k > 0 OR have THEN 'available' ELSE 'missing_for_set' END AS status, CASE WHEN live THEN k ELSE 0 END AS gene_rows, CASE WHEN NOT live THEN 0 WHEN k > 0 THEN ge ELSE me END::BIGINT AS exact, CASE WHEN NOT live THEN 0 WHEN k > 0 THEN gp ELSE mp END::BIGINT AS partial,
  CASE WHEN NOT live THEN 0 WHEN k > 0 THEN gu ELSE mu END::BIGINT AS unsupported, CASE WHEN live THEN mm + coalesce(gm, 0) ELSE 0 END::BIGINT AS mono, CASE WHEN NOT live THEN 0 WHEN k > 0 THEN gc ELSE mc END::BIGINT AS conflicts, coalesce(array_to_string(CASE WHEN live THEN best[1:20] END, ','), '') AS best,
  CASE WHEN off THEN '' WHEN away THEN 'long_read_not_available_for_source' WHEN k > 0 THEN 'long_read_deep' ELSE 'long_read_shallow' END AS risks FROM j""", views=False)
def a05_long_read_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reads of a set, from its genes or else from its models."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    status = F.when(flag == "A", "not_configured").when(flag == "R", F.when(part % 2 == 0, "available").otherwise("missing_for_model")).otherwise(F.when(F.col("l_orderkey") % 2 == 0, "available").otherwise("not_available_for_source"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("locus"), flag.alias("source"), F.concat(F.lit("g"), (F.col("l_suppkey") % 50).cast("string")).alias("gene_id"), status.alias("status"), _pick(_CLASSES, part % 7).alias("support"), (F.col("l_linenumber") % 2).alias("conflicts"), F.array(F.lit("shallow")).alias("risks"))
    i = F.col("id")
    g = spark.range(0, 50, 3).select(F.lit("R").alias("source"), F.concat(F.lit("g"), i.cast("string")).alias("gene_id"), F.when(i % 4 == 0, "mono_exon_not_assessable").otherwise("some").alias("level"), (i % 3).alias("exact"), (i % 2).alias("partial"), (i % 5).alias("unsupported"), (i % 2).alias("conflicts"), F.array(F.concat(F.lit("bg"), i.cast("string"))).alias("best"), F.array(F.lit("deep")).alias("risks"))
    return cards.long_read_sets(m, g).withColumns({"best": rules.joined(F.col("best")), "risks": rules.joined(F.col("risks"))})


@query("""WITH m AS (SELECT l_orderkey AS locus, l_linenumber % 3 AS set_id, 'C' || l_suppkey % 3 AS component, l_partkey % 4 AS introns, CASE WHEN l_quantity > 40 THEN 1 WHEN l_quantity > 25 THEN 2 WHEN l_quantity > 10 THEN 3 ELSE 4 END AS t FROM lineitem),
g AS (SELECT locus, component, count(DISTINCT set_id) AS sets, count(*) AS models, bool_and(introns = 0) AS mono, min(t) AS t FROM m GROUP BY ALL), a AS (SELECT *, mono AND sets < all_sets AS x FROM g JOIN (SELECT locus, count(DISTINCT set_id) AS all_sets FROM m GROUP BY locus) USING (locus))
SELECT locus, component, sets, all_sets, models, ['high', 'moderate', 'low', 'unsupported_or_not_assessed'][t] AS tier, CASE WHEN x THEN 'possible_extra_or_mono_exon_component' WHEN mono THEN 'mono_exon_protein_coding_component' ELSE 'protein_coding_transcript_component' END AS component_type,
  CASE WHEN x THEN 'possible extra mono-exon gene or candidate-specific coding unit' WHEN sets = all_sets THEN 'shared supported protein-coding transcript component' WHEN sets > 1 THEN 'supported coding component shared by a subset of candidate sets' ELSE 'candidate-specific protein-coding component' END AS claim,
  CASE WHEN x THEN 'uncertain_extra_component' WHEN sets = all_sets THEN 'shared_core_component' WHEN t = 1 THEN 'strong_component' ELSE 'candidate_specific_component' END AS role, CASE WHEN x THEN 'mono_exon_or_extra_gene_status' WHEN sets = all_sets THEN 'terminal_boundary_or_transcript_span' ELSE 'split_merge_or_component_presence' END AS uncertainty FROM a""", views=False)
def a21_component_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each component of a locus is, from the sets and models that have it."""
    q = F.col("l_quantity")
    tier = F.when(q > 40, "high").when(q > 25, "moderate").when(q > 10, "low").otherwise("unsupported_or_not_assessed")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("locus"), (F.col("l_linenumber") % 3).alias("set_id"), F.concat(F.lit("C"), (F.col("l_suppkey") % 3).cast("string")).alias("component"), (F.col("l_partkey") % 4).alias("introns"), tier.alias("tier"))
    return cards.component_layers(m)


@query(_N + "," + _K + _C.rstrip().rstrip(",") + """ SELECT locus, '# locus ' || locus || chr(10) || chr(10) || 'Region: chr1:1-570' || chr(10) || chr(10) || 'Question: which' || chr(10) || chr(10) || '| set | sources | interpretation | coding_qc | short_read_junction | long_read | protein |' || chr(10) || '|-|-|-|-|-|-|-|' || chr(10)
  || string_agg('| ' || concat_ws(' | ', set_id, replace(sources, ',', ', '), interpretation, coding_qc, short_read_junction, long_read, protein) || ' |', chr(10) ORDER BY set_id) || chr(10) AS card FROM c GROUP BY locus""", views=False)
def k15_review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown card of each locus."""
    g = _collapsed(spark, sf_dir).groupBy("locus").agg(F.collect_list(F.struct("set_id", "sources", "interpretation", "evidence")).alias("sets"))
    region = text.shown_region(F.lit("chr1"), F.lit(60), F.lit(70))
    return g.select("locus", writers.review_card(F.concat(F.lit("locus "), F.col("locus").cast("string")), region, F.lit("which"), F.col("sets")).alias("card"))


@query("""SELECT o_orderkey AS row_idx, 'ID=' || CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE 'o' END || o_orderkey || ';Name=' || CASE WHEN o_orderkey % 2 = 1 THEN 'n' WHEN o_orderkey % 3 = 0 THEN 'F' || o_orderkey ELSE 'o' || o_orderkey END || ';Parent=' || CASE WHEN o_custkey % 3 = 0 THEN 'F' ELSE 'o' END || o_custkey || ',x'
  || CASE WHEN o_orderkey % 3 = 0 THEN ';original_id=o' || o_orderkey ELSE '' END AS attributes FROM orders""", views=False)
def k07_renamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under final identifiers, with where they came from."""
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.concat(F.lit("ID=o"), o, F.lit(";Name="), F.when(F.col("o_orderkey") % 2 == 1, "n").otherwise(F.concat(F.lit("o"), o)), F.lit(";Parent=o"), c, F.lit(",x")).alias("attributes"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct().filter("n % 3 = 0")
    return writers.renamed(rows, ids.select(F.concat(F.lit("o"), F.col("n").cast("string")).alias("old_id"), F.concat(F.lit("F"), F.col("n").cast("string")).alias("final_id")))
