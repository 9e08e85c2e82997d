"""Audits of models on their sequences, repair of hierarchies, checks of a release, local decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.operators import eligibility, hierarchy, summaries
from locuskit.plans.registry import query
from locuskit.plans.structure import GENOME, genome
from locuskit.plans.views import exons, table

_AUDIT = GENOME + """, m AS (SELECT doc_id, seq, length(seq) AS n, CASE doc_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '+' WHEN 2 THEN '+' ELSE '-' END AS strand, 110 + doc_id % 4 + (doc_id % 7) * 10 AS e2, CASE WHEN doc_id % 13 = 0 THEN 45 ELSE 40 END AS c1, doc_id % 11 > 0 AS coding FROM g),
p AS (SELECT *, n > 0 AS have, n > 0 AND e2 > n AS beyond, (c1 - 4 + 1) + (e2 - 3 - 101 + 1) AS len, CASE WHEN strand = '-' THEN [(3 - (e2 - 103) % 3) % 3] ELSE [(3 - (c1 - 3) % 3) % 3] END AS second FROM m),
q AS (SELECT *, coding AND NOT beyond AND have AS usable, substr(seq, 4, (c1 - 3)::BIGINT) || substr(seq, 101, (e2 - 103)::BIGINT) AS fwd, substr(seq, 41, 60) AS i FROM p),
r AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(fwd, 'ACGT', 'TGCA')) ELSE fwd END AS cds, CASE WHEN strand = '-' THEN reverse(translate(i, 'ACGT', 'TGCA')) ELSE i END AS intron FROM q),
t AS (SELECT doc_id, list_filter([CASE WHEN NOT have THEN 'seqid_not_found_in_genome' END, CASE WHEN beyond THEN 'transcript_coordinates_out_of_bounds' END, CASE WHEN strand = '.' THEN 'invalid_or_missing_strand' END, CASE WHEN NOT coding THEN 'no_CDS_features' END,
    CASE WHEN coding AND c1 = 45 THEN 'CDS_not_nested_within_exon' END, CASE WHEN coding AND have AND NOT usable THEN 'CDS_sequence_unavailable_or_out_of_bounds' END, CASE WHEN coding AND len % 3 > 0 THEN 'CDS_length_mod3_invalid' END,
    CASE WHEN usable AND regexp_matches(left(cds, 3 * greatest((length(cds) // 3)::BIGINT - 1, 0)), '^(...)*?(TAA|TAG|TGA)') THEN 'internal_stop_present' END, CASE WHEN coding AND doc_id % 3 > 0 AND second[1] <> 1 THEN 'phase_inconsistent' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN usable AND left(cds, 3) <> 'ATG' THEN 'missing_start_codon' END, CASE WHEN usable AND right(cds, 3) NOT IN ('TAA', 'TAG', 'TGA') THEN 'missing_stop_codon' END,
    CASE WHEN have AND NOT beyond AND left(intron, 2) || '-' || right(intron, 2) NOT IN ('GT-AG', 'GC-AG', 'AT-AC') THEN 'noncanonical_splice' END], lambda x: x IS NOT NULL) AS warn FROM r)
SELECT doc_id, array_to_string(list_sort(hard), ';') AS hard, array_to_string(list_sort(warn), ';') AS warnings, CASE WHEN len(hard) > 0 THEN 'fail' WHEN len(warn) > 0 THEN 'warning' ELSE 'pass' END AS status, len(hard) = 0 AS eligible FROM t"""


@query(_AUDIT, views=False)
def r02_coding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding models of two exons against sequences in chunks of 64: what makes them ineligible, and what is a warning."""
    g, k = genome(spark, sf_dir), F.col("doc_id")
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 64).cast("int"))
    chunks = g.filter("seq <> ''").select(k.cast("string").alias("seqid"), "seq", F.explode(at).alias("c")).select("seqid", (F.col("c") + 1).alias("chunk_no"), (F.col("c") * 64 + 1).cast("long").alias("start"), F.substr("seq", F.col("c") * 64 + 1, F.lit(64)).alias("seq"))
    end, first = 110 + k % 4 + (k % 7) * 10, F.when(k % 13 == 0, 45).otherwise(40)
    block = lambda a, b: F.struct(F.lit(a).cast("long").alias("start"), b.cast("long").alias("end"))
    models = g.select(
        "doc_id", k.cast("string").alias("seqid"), F.lit(1).cast("long").alias("start"), end.alias("end"), F.when(k % 5 == 0, ".").when(k % 5 <= 2, "+").otherwise("-").alias("strand"), F.array(block(1, F.lit(40)), block(101, end)).alias("blocks"),
        F.when(k % 11 > 0, F.array(block(4, first), block(101, end - 3))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("coding"), F.when((k % 3 > 0) & (k % 11 > 0), F.array(F.lit(0), F.lit(1))).alias("phases"),
    )
    got = eligibility.audited_on(models, chunks, "doc_id")
    return got.select("doc_id", F.array_join("hard", ";").alias("hard"), F.array_join("warnings", ";").alias("warnings"), "status", "eligible")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release with faults: genes that aren't there, transcripts without a gene, parts that are all coding."""
    x = exons(spark, sf_dir)
    name = F.concat(F.lit("t"), F.col("tx_id").cast("string"))
    none = F.array().cast("array<string>")
    row = lambda df, at, feature, phase, ident, parents: df.select(at.cast("long").alias("row_idx"), F.col("seqid"), F.lit("s").alias("source"), feature.alias("feature"), "start", "end", "strand", phase.alias("phase"), ident.alias("id"), parents.alias("parents"))
    t = x.groupBy("tx_id", "gene_id", "seqid", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first = t.filter("tx_id % 7 > 0 and substr(gene_id, 2) % 3 > 0").groupBy("gene_id").agg(F.min_by(F.struct("seqid", "strand", "start", "end", "tx_id"), "tx_id").alias("r")).select("gene_id", "r.*")
    genes = row(first, -F.col("tx_id") - 1, F.lit("gene"), F.lit("."), F.col("gene_id"), none)
    tx = row(t, F.col("tx_id") * 100, F.lit("mRNA"), F.lit("."), name, F.when(F.col("tx_id") % 7 > 0, F.array("gene_id")).otherwise(none))
    coding = F.col("tx_id") % 5 == 0
    parts = row(x, F.col("tx_id") * 100 + F.col("exon_no"), F.when(coding, "CDS").otherwise("exon"), F.when(coding, "x").otherwise("1"), F.concat(F.lit("p"), name, F.lit("."), F.col("exon_no").cast("string")), F.array(name))
    return genes.unionByName(tx).unionByName(parts)


_REPAIRED = """, t AS (SELECT tx_id, gene_id, seqid, strand, s, e, tx_id % 7 = 0 AS lone, CASE WHEN tx_id % 7 = 0 THEN 't' || tx_id ELSE gene_id END AS gene, CASE WHEN tx_id % 7 = 0 THEN 't' || tx_id || '.t01' ELSE 't' || tx_id END AS name FROM tx)
SELECT 'gene' AS feature, gene AS id, min(s) AS start, max(e) AS "end", '.' AS phase, '' AS parent, CASE WHEN any_value(lone) THEN 'synthetic_gene_from_top_level_transcript' WHEN any_value(substr(gene_id, 2)::BIGINT) % 3 = 0 THEN 'synthetic_gene_from_transcript_parent' ELSE '' END AS repair FROM t GROUP BY gene
UNION ALL SELECT 'mRNA', name, s, e, '.', gene, '' FROM t
UNION ALL SELECT CASE WHEN tx_id % 5 = 0 THEN 'CDS' ELSE 'exon' END, 'pt' || tx_id || '.' || exon_no, x.s, x.e, CASE WHEN tx_id % 5 = 0 THEN '0' ELSE '.' END, name, '' FROM exon x JOIN t USING (tx_id)
UNION ALL SELECT 'exon', name || '.exon' || lpad(exon_no::VARCHAR, 3, '0'), x.s, x.e, '.', name, 'synthetic_exon_from_cds_or_utr' FROM exon x JOIN t USING (tx_id) WHERE tx_id % 5 = 0"""


@query(_REPAIRED)
def g14_repaired_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes and exons that a release lacks are made, transcripts renamed, phases set."""
    made = hierarchy.repaired(_rows(spark, sf_dir))
    return made.select("feature", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "phase", F.array_join("parents", ",").alias("parent"), "repair")


_CHECKS = """, t AS (SELECT tx_id, gene_id, seqid, s, e, strand FROM tx), g AS (SELECT gene_id, min_by({'q': seqid, 's': s, 'e': e, 'd': strand}, tx_id) AS p FROM t WHERE tx_id % 7 > 0 AND substr(gene_id, 2)::BIGINT % 3 > 0 GROUP BY gene_id)
SELECT 'duplicate_gene_tx_exon_ids' AS "check", 0::BIGINT AS n UNION ALL SELECT 'invalid_cds_phase', count(*) FILTER (tx_id % 5 = 0) FROM exon UNION ALL SELECT 'invalid_non_cds_phase', count(*) FILTER (tx_id % 5 > 0) FROM exon
UNION ALL SELECT 'missing_parent_refs', count(*) FILTER (tx_id % 7 > 0 AND substr(gene_id, 2)::BIGINT % 3 = 0) FROM t
UNION ALL SELECT 'child_outside_parent', count(*) FROM t JOIN g USING (gene_id) WHERE tx_id % 7 > 0 AND (seqid <> p.q OR (strand <> p.d AND strand IN ('+', '-') AND p.d IN ('+', '-')) OR s < p.s OR e > p.e)"""


@query(_CHECKS)
def r36_release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what is wrong with a release before its repair."""
    return hierarchy.post_checks(_rows(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey AS card_id, list({'i': 'S' || l_linenumber, 'w': CASE l_returnflag WHEN 'R' THEN '' ELSE l_returnflag END, 'f': CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE l_linestatus END, 'r': CASE WHEN l_partkey % 4 = 0 THEN ['a' || l_suppkey % 3] ELSE [] END} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS sets FROM lineitem GROUP BY ALL),
c AS (SELECT card_id, CASE WHEN o_orderkey % 3 = 0 THEN 'conflicting' WHEN o_orderkey % 3 = 1 THEN 'clear' ELSE 'weak' END AS d, o_orderkey % 3 = 0 AND o_custkey % 2 = 0 AND o_orderpriority <> '5-LOW' AS risky, coalesce(list_filter(sets, lambda x: x.i = 'S' || (1 + o_custkey % 9))[1], sets[1]) AS p FROM s JOIN orders ON card_id = o_orderkey)
SELECT card_id, CASE WHEN risky THEN 'risk_flagged' ELSE 'select_annotation_set' END AS decision, p.i AS selected_set_id, CASE WHEN risky THEN 'low' WHEN d = 'clear' THEN 'high' WHEN d = 'weak' THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN risky THEN 'unresolved_mutually_exclusive_candidate_sets' ELSE array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p.w = '' THEN 'selected_listed_annotation_set' ELSE p.w END, p.f], lambda x: x <> ''))), ';') END AS reason_tags, CASE WHEN risky THEN 'risk_flagged_by_card_comparison' ELSE array_to_string(p.r, ';') END AS risk_tags FROM c""", views=False)
def r26_local_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by rule: the recommended set where the card lists it, else its first one; conflicts that nothing settles are flagged."""
    rule = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    one = F.struct(
        rule.alias("at"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("set_id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("interpretation"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linestatus")).alias("component_fit"),
        F.when(F.col("l_partkey") % 4 == 0, F.array(F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string")))).alias("risks"),
    )
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.array_sort(F.collect_list(one)).alias("sets"))
    k = F.col("o_orderkey") % 3
    compared = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("card_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 9 + 1).cast("string")).alias("recommended_set_id"), F.when(k == 0, "conflicting").when(k == 1, "clear").otherwise("weak").alias("discriminator_status"),
        F.when(F.col("o_custkey") % 2 == 0, "risk_if_unresolved_conflict").otherwise("choose_best").alias("recommended_default"), F.when(F.col("o_orderpriority") == "5-LOW", "none").otherwise("cds").alias("main_conflict"),
    )
    got = summaries.local_decisions(sets.join(compared, "card_id"))
    return got.select("card_id", "decision", "selected_set_id", "confidence", F.array_join("reason_tags", ";").alias("reason_tags"), F.array_join("risk_tags", ";").alias("risk_tags"))
