"""Proposal catalogue, policy export, gene blocks, support cache and styles over projections of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.operators import allocation, blocks, proposals, support_store
from locuskit.plans.registry import query
from locuskit.plans.views import table, transcripts
from locuskit.session import shared_dir


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GFF of customers as genes (every tenth listed twice), orders as transcripts and lines as coding blocks.

    Some transcripts name their gene by geneID, some lines have no transcript but a gene_id, and some orders no gene at all.
    """
    c, o, x = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = lambda v: F.col(v).cast("string")
    row = lambda seq, kind, start, length, phase, attrs: F.concat_ws("\t", seq, F.lit("p"), F.lit(kind), start.cast("string"), (start + length).cast("string"), F.lit("."), F.lit("+"), F.lit(phase), attrs)
    told = F.concat(
        F.lit(";proposal_catalog=true;locus_id=L"), s("c_nationkey"), F.when(F.col("c_custkey") % 4 == 0, ";export_readiness=pending_validation_before_export").when(F.col("c_custkey") % 4 == 1, "").otherwise(";export_readiness=manual_review_required_before_export;final_call=novel_gene_candidate_manual_review"),
        F.lit(";replaces_current_genes=g"), (F.col("c_custkey") + 1).cast("string"), F.lit(",g"), (F.col("c_custkey") + 2).cast("string"), F.lit(";source_model_id=m"), s("c_custkey"),
    )
    gene = row(F.concat(F.lit("chr"), s("c_nationkey")), "gene", F.col("c_custkey") * 10, F.lit(9), ".", F.concat(F.lit("ID=g"), s("c_custkey"), told))
    genes = c.select((F.col("c_custkey") * 10).alias("row_idx"), gene.alias("line")).union(c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") * 10 + 5).alias("row_idx"), F.concat(gene, F.lit(";second=1")).alias("line")))
    parent = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(";Parent=none;geneID=g"), s("o_custkey"))).when(F.col("o_orderkey") % 5 == 1, ";Parent=none").otherwise(F.concat(F.lit(";Parent=g"), s("o_custkey")))
    tx = o.select((F.col("o_orderkey") * 10 + 10**9).alias("row_idx"), row(F.lit("chr"), "mRNA", F.col("o_orderkey"), F.lit(1), ".", F.concat(F.lit("ID=t"), s("o_orderkey"), parent)).alias("line"))
    owner = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Parent=none,t"), s("l_orderkey"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("gene_id=g"), (F.col("l_orderkey") % 100).cast("string"))).otherwise(F.concat(F.lit("Parent=t"), s("l_orderkey")))
    part = x.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 2 * 10**9).alias("row_idx"), row(F.lit("chr"), "CDS", F.col("p"), F.lit(2), "0", owner).alias("line"))
    return genes.union(tx).union(part)


_BLOCKS = """WITH ln AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
gene AS (SELECT c_custkey AS k, c_nationkey, 0 AS d FROM customer UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer WHERE c_custkey % 10 = 0),
ow AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 1 THEN o_custkey END AS owner FROM orders),
told AS (SELECT *, ';proposal_catalog=true;locus_id=L' || c_nationkey || CASE k % 4 WHEN 0 THEN ';export_readiness=pending_validation_before_export' WHEN 1 THEN '' ELSE ';export_readiness=manual_review_required_before_export;final_call=novel_gene_candidate_manual_review' END
  || ';replaces_current_genes=g' || (k + 1) || ',g' || (k + 2) || ';source_model_id=m' || k AS attrs FROM gene),
rowset AS (
  SELECT k * 10 + 5 * d AS row_idx, 'g' || k || CASE d WHEN 1 THEN '__duplicate_2' ELSE '' END AS block, 0 AS rank, concat_ws(chr(9), 'chr' || c_nationkey, 'p', 'gene', k * 10, k * 10 + 9, '.', '+', '.', 'ID=g' || k || attrs || CASE d WHEN 1 THEN ';second=1' ELSE '' END) AS line, false AS ambiguous FROM told
  UNION ALL SELECT o_orderkey * 10 + 1000000000, 'g' || o_custkey, 1, concat_ws(chr(9), 'chr', 'p', 'mRNA', o_orderkey, o_orderkey + 1, '.', '+', '.', 'ID=t' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN ';Parent=none;geneID=g' || o_custkey ELSE ';Parent=g' || o_custkey END), o_custkey % 10 = 0
  FROM orders WHERE o_orderkey % 5 <> 1 AND o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 2000000000, 'g' || g, 2, concat_ws(chr(9), 'chr', 'p', 'CDS', p, p + 2, '.', '+', '0', CASE l_linenumber WHEN 1 THEN 'Parent=none,t' || l_orderkey WHEN 2 THEN 'gene_id=g' || g ELSE 'Parent=t' || l_orderkey END), g % 10 = 0
  FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN l_orderkey % 100 ELSE owner END AS g FROM ln JOIN ow ON l_orderkey = o_orderkey) WHERE g IN (SELECT c_custkey FROM customer))
"""


@query(_BLOCKS + "SELECT row_idx, block, ambiguous FROM rowset", views=False)
def s04_gene_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the gene block it belongs to, repeated genes apart."""
    return blocks.gene_blocks(_lines(spark, sf_dir)).select("row_idx", "block", "ambiguous")


_POLICY = _BLOCKS + """, d AS (SELECT k, d, c_nationkey, CASE WHEN k % 4 = 0 THEN 'keep_pending_validation_replacement' WHEN k % 4 = 1 THEN 'keep_current_or_base_backbone' WHEN c_nationkey % 5 = 0 THEN 'drop_novel_not_strong_moderate_or_unsupported'
    WHEN c_nationkey % 3 = 0 THEN 'keep_supported_multitool_novel' WHEN k % 3 = 0 THEN 'keep_supported_singletool_junction_novel' ELSE 'drop_supported_singletool_no_full_or_partial_junction' END AS reason FROM gene),
back AS (SELECT DISTINCT k + i AS k FROM d, (SELECT unnest([1, 2]) AS i) WHERE reason LIKE 'drop%'),
blk AS (SELECT 0 AS origin, 'g' || k || CASE d WHEN 1 THEN '__duplicate_2' ELSE '' END AS block, reason FROM d WHERE reason LIKE 'keep%'
  UNION ALL SELECT 1, 'g' || gene.k || CASE gene.d WHEN 1 THEN '__duplicate_2' ELSE '' END, 'restored' FROM gene JOIN back ON gene.k = back.k)
SELECT origin, block, reason, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY rank, row_idx)) AS text_sha256
FROM blk JOIN (SELECT row_idx, block, CASE rank WHEN 2 THEN 2 ELSE rank END AS rank, line FROM rowset) r USING (block) GROUP BY ALL"""


@query(_POLICY, views=False)
def k06_policy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that a policy lets out or brings back, and a digest of each one's raw lines in order.

    The same file stands for the catalogue and for the current annotation, whose genes aren't marked as proposals.
    """
    found = blocks.gene_blocks(_lines(spark, sf_dir))
    n = table(spark, sf_dir, "nation")
    calls = n.select(
        F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("locus_id"), F.lit("novel_gene_candidate_manual_review").alias("final_call"), F.when(F.col("n_nationkey") % 5 == 0, "weak").otherwise("strong").alias("best_evidence_level"),
        F.lit("false").alias("manual_review_unsupported_locus"), F.when(F.col("n_nationkey") % 3 == 0, "ToolA,ToolB").otherwise("ToolA,current").alias("member_real_sources"),
    )
    c = table(spark, sf_dir, "customer")
    models = c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("model_id"), F.when(F.col("c_custkey") % 3 == 0, "full_junction_support").otherwise("none_observed").alias("rna_junction_status"))
    # Known to be empty when planned, so that no coding line is shuffled for a join that finds nothing.
    none = spark.createDataFrame([], "export_gene_id string, source_model_id string").limit(0)
    support = spark.createDataFrame([], "locus_id string, cds_signature string, source string").limit(0)
    made = blocks.policy_blocks(found, found, calls, none, models, support, "supported_novel_singletool_junction_supported")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in blocks.IN_BLOCK.items() for x in kv]), F.col("feature")), F.lit(5))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "row_idx", "line"))), lambda x: x["line"]), "\n")
    out = made["rows"].groupBy("origin", "block").agg(F.count("*").alias("lines"), F.sha2(whole, 256).alias("text_sha256"))
    reasons = made["decisions"].filter("include").select("block", "reason")
    return out.join(reasons, "block", "left").select("origin", "block", F.when(F.col("origin") == 1, "restored").otherwise(F.col("reason")).alias("reason"), "lines", "text_sha256")


_CATALOGUE = """, m AS (SELECT tx_id, tx_id // 4 AS locus, source, gene_id, seqid, strand, s, e, source || ':' || gene_id || ':' || tx_id AS model FROM tx),
loc AS (SELECT locus, bool_or(source = 'current') AS cur, string_agg(DISTINCT CASE WHEN source = 'current' THEN gene_id END, ';' ORDER BY CASE WHEN source = 'current' THEN gene_id END) AS genes, count(*) FILTER (source IN ('ToolA', 'ToolB')) AS tools FROM m GROUP BY locus),
act AS (SELECT *, CASE WHEN locus % 3 = 1 THEN 'keep_current' WHEN locus % 3 = 2 OR tools = 0 THEN 'keep_current_no_selected_model' WHEN cur THEN 'replace_current_with_selected_set' ELSE 'add_novel_selected_set' END AS action FROM loc),
pick AS (SELECT m.*, action, genes FROM m JOIN act USING (locus) WHERE action IN ('replace_current_with_selected_set', 'add_novel_selected_set') AND source IN ('ToolA', 'ToolB')),
grp AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY f, gene_id, seqid, strand) AS gi FROM (SELECT locus, gene_id, seqid, strand, min(s) AS f FROM pick GROUP BY ALL)),
num AS (SELECT pick.*, gi, row_number() OVER (PARTITION BY pick.locus, pick.gene_id, pick.seqid, pick.strand ORDER BY s, model) AS ti FROM pick JOIN grp USING (locus, gene_id, seqid, strand)),
cl AS (SELECT tx_id, sum(e - s + 1) AS n, count(*) AS k FROM cds GROUP BY tx_id)
SELECT 'L' || locus AS locus_id, action AS proposal_action, 'Prop_L' || locus || '_S1_g' || lpad(gi::VARCHAR, 2, '0') || '.t' || lpad(ti::VARCHAR, 2, '0') AS export_transcript_id, model AS source_model_id, s AS "start", e AS "end", coalesce(n, 0)::BIGINT AS cds_length, coalesce(k, 0)::BIGINT AS cds_count, CASE WHEN action LIKE 'replace%' THEN genes ELSE '' END AS removed
FROM num LEFT JOIN cl USING (tx_id)
UNION ALL SELECT 'L' || locus, action, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM act WHERE action LIKE 'keep%'"""


def _catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = transcripts(spark, sf_dir).withColumn("locus", F.floor(F.col("tx_id") / 4))
    of = lambda name: F.lit(None).cast("string").alias(name)
    ident = F.concat_ws(":", "source", "gene_id", F.col("tx_id").cast("string"))
    model = F.struct(ident.alias("model_id"), of("source"), of("gene_id"), of("transcript_id"), of("source_gene_id"), of("source_transcript_id"), "seqid", "strand", "start", "end", F.col("blocks").alias("exons"), F.col("coding").alias("cds"))
    name = F.concat(F.lit("L"), F.col("locus").cast("string"))
    cards = t.groupBy(name.alias("locus_id")).agg(F.collect_list(model).alias("candidate_models"), F.max("tx_id").alias("row_idx"))
    tools = F.array_join(F.array_sort(F.collect_list(F.when(F.col("source").isin("ToolA", "ToolB"), ident))), ",")
    called = t.filter("locus % 3 < 2").groupBy("locus").agg(F.when(F.col("locus") % 3 == 0, tools).otherwise("").alias("ids"), F.max("tx_id").alias("row_idx"))
    held = {"final_call": F.when(F.col("locus") % 3 == 0, "replace_current_candidate").otherwise("keep_current"), "selected_model_id": F.col("ids"), "selected_real_set_id": F.lit("S1")}
    calls = called.select(name.alias("locus_id"), "row_idx", *[held.get(c, F.lit("")).alias(c) for c in proposals.CALL])
    return proposals.catalogue(cards, calls, prefix="Prop")


@query(_CATALOGUE)
def k05_catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a proposal catalogue: what is done with each locus, and its numbered genes and transcripts."""
    r = _catalogue(spark, sf_dir)["records"]
    return r.select("locus_id", "proposal_action", "export_transcript_id", "source_model_id", "start", "end", "cds_length", F.col("cds_count").cast("long").alias("cds_count"), F.col("removed_current_gene_ids").alias("removed"))


_SUPPORT = """, c AS (SELECT tx_id, source, 'L' || tx_id // 4 AS locus_id, '["' || seqid || '","' || strand || '",[' || string_agg(b, ',' ORDER BY s, e) || ']]' AS cds_signature
  FROM (SELECT DISTINCT tx_id, source, seqid, strand, s, e, '[' || s || ',' || e || ',"0"]' AS b FROM cds WHERE source <> 'current') GROUP BY tx_id, source, seqid, strand)
SELECT locus_id, cds_signature, string_agg(DISTINCT source, ',' ORDER BY source) AS supporting_sources, count(DISTINCT source) AS support_count FROM c GROUP BY ALL"""


@query(_SUPPORT)
def k14_support_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact coding structures of each locus and the tools that have them, kept in a store and read back."""
    t = transcripts(spark, sf_dir)
    cds = F.transform("coding", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit("0").alias("phase")))
    models = t.select(F.concat(F.lit("L"), F.floor(F.col("tx_id") / 4).cast("string")).alias("locus_id"), "source", "seqid", "strand", cds.alias("cds"))
    held, _ = support_store.refreshed(f"{shared_dir(spark)}/support-{uuid.uuid4().hex}", models)
    return support_store.cache_rows(held)


_STYLES = """WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'Q' ELSE 'N' || c_nationkey || 'G' END AS p FROM customer),
cnt AS (SELECT n, p, count(*) AS m, min(p || lpad((k * 20)::VARCHAR, 7, '0')) AS f FROM c GROUP BY n, p), best AS (SELECT n, p FROM cnt QUALIFY row_number() OVER (PARTITION BY n ORDER BY m DESC, f) = 1),
num AS (SELECT p, k * 20 AS x, k * 20 - lag(k * 20) OVER (PARTITION BY p ORDER BY k) AS d FROM c), st AS (SELECT p, max(x) AS top, coalesce(list_reduce(list(d) FILTER (d IS NOT NULL), lambda a, b: gcd(a, b)), 1) AS step FROM num GROUP BY p),
q AS (SELECT s_suppkey, p, row_number() OVER (PARTITION BY p ORDER BY 'chr' || s_nationkey, s_suppkey, 's' || s_suppkey) AS r FROM supplier JOIN best ON n = s_nationkey)
SELECT 's' || s_suppkey AS new_id, p || lpad((top + r * step)::VARCHAR, 7, '0') AS gene_id, 'inferred_local_source_id_style' AS basis FROM q JOIN st USING (p)"""


@query(_STYLES, views=False)
def g10_style_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New genes numbered in the commonest style of their sequence, above its largest number, by its common step."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    prefix = F.when(F.col("c_custkey") % 4 == 0, "Q").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("G")))
    current = c.select(F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("seqid"), text.numbered_id(prefix, F.col("c_custkey") * 20, 7).alias("gene_id"))
    new = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("new_id"), F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("seqid"), F.col("s_suppkey").alias("start"))
    return allocation.style_ids(new, current, current.select("gene_id"))
