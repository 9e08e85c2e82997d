"""Lineage, identifiers, hierarchies, formats, mappings and release modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.operators import allocation, blocks, components, islands, lineage, tables
from locuskit.plans.registry import query
from locuskit.plans.views import exons, table, transcripts
from locuskit.session import written
from locuskit.sources import readers, writers


def _gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons as lines of a GFF3 text, with comments and broken lines among them."""
    x = exons(spark, sf_dir)
    row = x.withColumns({"feature": F.lit("exon"), "score": F.lit("."), "phase": F.lit(".")})
    attributes = F.concat(F.lit("ID="), F.col("tx_id").cast("string"), F.lit("."), F.col("exon_no").cast("string"), F.lit(";Parent="), F.col("tx_id").cast("string"))
    line = F.when(F.col("reads") == 50, "# comment").when(F.col("reads") == 49, "chr1\tx\texon\tnone\t7\t.\t+\t.\tID=1").when(F.col("reads") == 48, F.concat_ws("\t", "seqid", "source", "feature", F.concat(F.col("end").cast("string"), F.lit(".0")), "start", "score", "strand", "phase", attributes))
    return row.select((F.col("tx_id") * 100 + F.col("exon_no")).alias("row_idx"), F.coalesce(line, writers.gff_line(attributes)).alias("line"))


@query("SELECT tx_id * 100 + exon_no AS row_idx, seqid, s AS start, e AS \"end\", strand, tx_id::VARCHAR AS parent FROM exon WHERE reads < 49")
def s01_gff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to rows: comments and broken lines go, decimals and reversed bounds are mended."""
    rows = readers.gff_rows(_gff_lines(spark, sf_dir))
    return rows.select("row_idx", "seqid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", text.attribute(text.attribute_pairs(F.col("attributes")), "Parent").alias("parent"))


@query("SELECT 't' || tx_id AS seqid, exon_no::INTEGER AS chunk_no, (1 + coalesce(sum(4 * (reads % 7 + 1)) OVER (PARTITION BY tx_id ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, repeat('ACGT', (reads % 7 + 1)::INTEGER) AS seq FROM exon")
def s15_fasta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of FASTA files as chunks with their sequence, number and place; headers are carried from bin to bin."""
    x = exons(spark, sf_dir).select("tx_id", "exon_no", "reads", F.concat(F.lit("f"), (F.col("tx_id") % 3).cast("string")).alias("file"))
    head = x.select("file", "tx_id").distinct().select("file", (F.col("tx_id") * 100).alias("row_idx"), F.concat(F.lit(">t"), F.col("tx_id").cast("string"), F.lit(" a sequence")).alias("line"))
    body = x.select("file", (F.col("tx_id") * 100 + F.col("exon_no")).alias("row_idx"), F.repeat(F.lit("acgt"), (F.col("reads") % 7 + 1).cast("int")).alias("line"))
    return readers.fasta(head.union(body), 4096)


@query("SELECT 'lab|t' || tx_id AS hit_id, seqid, min(strand) AS strand, min(s) AS start, max(e) AS \"end\", count(*) AS parts FROM exon GROUP BY tx_id, seqid")
def s16_protein_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of alignments with their hit: by Parent, or the hit before them on the sequence."""
    x = exons(spark, sf_dir).select("tx_id", "exon_no", "seqid", "strand", "start", "end")
    name = F.concat(F.lit("t"), F.col("tx_id").cast("string"))
    hit = x.groupBy("tx_id", "seqid", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end")).select((F.col("tx_id") * 100).alias("row_idx"), "seqid", "strand", "start", "end", F.lit("match").alias("feature"), F.concat(F.lit("ID="), name).alias("attributes"))
    part = x.select((F.col("tx_id") * 100 + F.col("exon_no")).alias("row_idx"), "seqid", "strand", "start", "end", F.lit("match_part").alias("feature"), F.when(F.col("tx_id") % 3 == 0, F.concat(F.lit("Parent="), name)).otherwise("Target=x").alias("attributes"))
    return readers.protein_hits(hit.unionByName(part), "lab", 4096)


@query("SELECT CASE WHEN reads = 49 THEN 'bounds' WHEN reads = 48 AND e > s THEN 'order' ELSE 'none' END AS reject, count(*) AS n FROM exon WHERE reads < 50 GROUP BY ALL")
def s03_gff_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict reader's counts of what it rejects."""
    return readers.gff_rows(_gff_lines(spark, sf_dir), strict=True).groupBy(F.coalesce("reject", F.lit("none")).alias("reject")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(chr(9), seqid, source, 'exon', s, e, '.', strand, '.', 'gene_id \"' || gene_id || '\"; transcript_id \"' || tx_id || '\";') AS line FROM (SELECT tx_id AS l_orderkey, exon_no AS l_linenumber, * FROM exon)")
def k09_gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = exons(spark, sf_dir).withColumns({"feature": F.lit("exon"), "score": F.lit("."), "phase": F.lit(".")})
    return x.select(F.col("tx_id").alias("l_orderkey"), F.col("exon_no").alias("l_linenumber"), writers.gtf_line(F.col("gene_id"), F.col("tx_id").cast("string")).alias("line"))


_CLEAN = """WITH r AS (SELECT p_partkey, ['gene', 'mRNA', 'CDS', 'exon', 'lnc_RNA', 'stop_codon'][1 + p_partkey % 6] AS feature, p_partkey::VARCHAR AS id,
  CASE WHEN p_size % 3 = 0 THEN p_partkey::VARCHAR WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS biotype FROM part),
k AS (SELECT *, lower(feature) AS f FROM r)
SELECT p_partkey, concat_ws(';', 'ID=' || id, CASE WHEN f <> 'gene' THEN 'Parent=g' END, CASE WHEN f IN ('gene', 'mrna', 'lnc_rna') AND name <> id AND name <> '' THEN 'Name=' || replace(replace(name, '#', '%23'), ' ', '%20') END,
  CASE WHEN f IN ('gene', 'mrna', 'lnc_rna') THEN 'biotype=' || CASE WHEN biotype <> '' THEN replace(biotype, ' ', '%20') WHEN f = 'gene' THEN 'gb' ELSE 'tb' END END, CASE WHEN f = 'cds' THEN 'protein_id=p1' END) AS attributes,
  CASE f WHEN 'gene' THEN 0 WHEN 'mrna' THEN 1 WHEN 'lnc_rna' THEN 1 WHEN 'exon' THEN 2 WHEN 'cds' THEN 4 ELSE 5 END AS rank FROM k"""


@query(_CLEAN, views=False)
def k10_clean_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a release keeps of each class of feature, and the rank of the feature."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    feature = F.element_at(F.array(*map(F.lit, ("gene", "mRNA", "CDS", "exon", "lnc_RNA", "stop_codon"))), (k % 6 + 1).cast("int"))
    name = F.when(F.col("p_size") % 3 == 0, k.cast("string")).when(F.col("p_size") % 3 == 1, text.encoded(F.col("p_brand"))).otherwise("")
    biotype = F.when(F.col("p_size") % 2 == 0, text.encoded(F.col("p_type"))).otherwise("")
    line = F.concat(F.lit("trace=1;protein_id=p1;biotype="), biotype, F.lit(";gene_biotype=gb;transcript_biotype=tb;exon_number=3;Note=x;Name="), name, F.lit(";Parent=g;ID=0;ID="), k.cast("string"))
    kept = writers.clean_attributes(text.attribute_pairs(line), feature)
    return part.select("p_partkey", text.released_text(kept).alias("attributes"), writers.feature_rank(feature).cast("int").alias("rank"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0)", views=False)
def f10_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows without those of replaced genes."""
    replaced = table(spark, sf_dir, "customer").filter("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(replaced, "o_custkey", "left_anti").select("o_orderkey")


_TREE = """WITH RECURSIVE edge AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
below AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey % 8 = 3 UNION SELECT child FROM below JOIN edge ON parent = node)
"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(o.select(name("c", "o_custkey"), name("o", "o_orderkey")))
    return edges, n.filter("n_nationkey % 8 = 3").select(name("n", "n_nationkey").alias("node"))


@query(_TREE + "SELECT node FROM below", views=False)
def g05_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.descendants(*_tree(spark, sf_dir))


@query(_TREE + "SELECT child AS node FROM edge WHERE child NOT IN (SELECT node FROM below)", views=False)
def f14_subtree_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left when some nodes and all below them go."""
    edges, roots = _tree(spark, sf_dir)
    return edges.select(F.col("child").alias("node")).join(components.descendants(edges, roots), "node", "left_anti")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing_parent' WHEN c_nationkey % 2 <> o_orderkey % 2 THEN 'other_strand' ELSE 'ok' END AS status FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 > 0) ON o_custkey = c_custkey", views=False)
def j24_parent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children against their parents: missing ones and ones that disagree."""
    parents = table(spark, sf_dir, "customer").filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    found = tables.parent_status(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parents, "o_custkey", F.col("c_nationkey_p") % 2 != F.col("o_orderkey") % 2)
    return found.select("o_orderkey", "status")


@query("SELECT gene_id, source FROM (SELECT gene_id, source, count(DISTINCT l) AS n FROM (SELECT gene_id, source, e - s + 1 AS l FROM cds ) GROUP BY ALL) JOIN (SELECT gene_id, count(DISTINCT e - s + 1) AS total FROM cds GROUP BY ALL) USING (gene_id) WHERE n = total")
def a17_supporting_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have every coding length of a gene: relational division by two counts."""
    c = transcripts(spark, sf_dir).select("gene_id", "source", F.explode("coding").alias("b")).select("gene_id", "source", (F.col("b.end") - F.col("b.start") + 1).alias("l"))
    item = c.select("gene_id", "source", F.concat_ws(":", "gene_id", F.col("l").cast("string")).alias("item"))
    return blocks.supported_by_all(item, item, ["item"], "gene_id")


@query("SELECT l_suppkey, gcd_step AS step FROM (SELECT l_suppkey, list_reduce(list_prepend(0::BIGINT, list(d)), lambda a, b: gcd(a, b)) AS gcd_step FROM (SELECT l_suppkey, k - lag(k) OVER (PARTITION BY l_suppkey ORDER BY k) AS d FROM (SELECT DISTINCT l_suppkey, l_partkey * 5 AS k FROM lineitem)) WHERE d IS NOT NULL GROUP BY l_suppkey)", views=False)
def a26_numeric_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest common divisor of the differences between a key's numbers."""
    k = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 5).alias("k"))
    return islands.numeric_steps(k, ["l_suppkey"], "k")


@query("WITH n AS (SELECT c_nationkey, c_custkey % 100 >= 85 AS s, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY ALL) SELECT c_nationkey, s AS style, n AS genes, n >= 0.80 * t AND n >= 10 AS dominant FROM (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) AS k FROM n) WHERE k = 1", views=False)
def a28_dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest identifier style of a source, and whether it dominates: four fifths of the genes, and ten; of equals the first met."""
    c = table(spark, sf_dir, "customer").withColumn("s", F.col("c_custkey") % 100 >= 85)
    n = allocation.style_counts(c, ["c_nationkey"], ["s"], "c_custkey")
    return n.select("c_nationkey", F.col("style.s").alias("style"), F.col("n").alias("genes"), ((F.col("n") >= allocation.DOMINANT * F.col("all")) & (F.col("n") >= allocation.SEVERAL)).alias("dominant"))


@query("SELECT o_custkey AS locus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS names, count(DISTINCT o_orderstatus) AS relations, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) - count(DISTINCT CASE WHEN o_orderstatus = 'F' AND k > 0 THEN o_orderpriority END) AS retired FROM (SELECT *, max(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, o_orderpriority) AS k FROM orders) GROUP BY o_custkey", views=False)
def a16_locus_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new names of a locus and how many old ones are gone."""
    o = table(spark, sf_dir, "orders")
    g = tables.name_mapping(o, ["o_custkey"], "o_orderpriority", F.col("o_orderstatus") == "F").join(o.groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("relations")), "o_custkey")
    return g.select(F.col("o_custkey").alias("locus"), F.array_join("names", ",").alias("names"), "relations", "retired")


@query("SELECT p_brand AS key, p_partkey AS kept FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey DESC) AS k FROM part) WHERE k = 1", views=False)
def u10_manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the new manifest over those of the old one, by key."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("kept"), F.col("p_size"))
    last = lambda df: tables.first_of_key(df, ["key"], -F.col("kept")).select("key", "kept")
    return tables.upserted(last(p.filter("p_size <= 25")), last(p.filter("p_size > 25")), ["key"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'GeneG' || lpad((k + (SELECT max(c_custkey) FROM customer))::VARCHAR, 8, '0') ELSE 'GeneG' || lpad(c_custkey::VARCHAR, 8, '0') END AS gene FROM (SELECT *, row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY c_custkey) AS k FROM customer)", views=False)
def w11_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identifiers in order above the largest known number; known ones stay."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("new"), (F.col("c_custkey") / 1000).cast("long").alias("bucket"))
    top = c.agg(F.max("c_custkey").alias("top"))
    new = islands.numbered(c.filter("new"), ["c_custkey"], "k", ["bucket"]).join(F.broadcast(top)).select("c_custkey", (F.col("k") + F.col("top")).alias("n"))
    both = new.union(c.filter("not new").select("c_custkey", F.col("c_custkey").alias("n")))
    return both.select("c_custkey", text.numbered_id("GeneG", F.col("n"), 8).alias("gene"))


def lineage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, old_id, new_id and the score vector of current against tool models of a window."""
    t = transcripts(spark, sf_dir).withColumn("locus", F.floor(F.col("tx_id") / 4))
    side = lambda k: t.filter(k).select("locus", F.col("tx_id").cast("string").alias("id"), "start", "end", "coding")
    return lineage.structural_scores(side("tx_id % 4 < 2"), side("tx_id % 4 >= 2"), "locus")


# Windows hold two models of either side at most, so the assignments of the smaller side are the shifts of the larger one.
_ASSIGNED = """, c AS (SELECT t.tx_id, t.tx_id // 4 AS locus, t.tx_id % 4 < 2 AS old, t.s, t.e, coalesce(any_value(k), []) AS k, coalesce(any_value(cn), 0) AS n
  FROM tx t LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e} ORDER BY s, e) AS k, sum(e - s + 1)::BIGINT AS cn FROM cds GROUP BY tx_id) USING (tx_id) GROUP BY ALL),
p AS (SELECT o.locus, o.tx_id AS old_id, n.tx_id AS new_id, o.s AS os, n.s AS ns, o.n + n.n AS total,
    coalesce(list_sum(flatten(list_transform(o.k, lambda u: list_transform(n.k, lambda v: greatest(0, least(u.e, v.e) - greatest(u.s, v.s) + 1))))), 0)::BIGINT AS bp,
    len(list_distinct(list_filter(o.k, lambda u: list_contains(n.k, u))))::BIGINT AS exact, greatest(0, least(o.e, n.e) - greatest(o.s, n.s) + 1)::BIGINT AS span, (-abs((o.s + o.e) // 2 - (n.s + n.e) // 2))::BIGINT AS near
  FROM c o JOIN c n ON o.locus = n.locus AND o.old AND NOT n.old),
q AS (SELECT *, CASE WHEN total > bp THEN bp * 1000000 // (total - bp) ELSE 0 END AS ppm, dense_rank() OVER (PARTITION BY locus ORDER BY os, old_id::VARCHAR) - 1 AS i, dense_rank() OVER (PARTITION BY locus ORDER BY ns, new_id::VARCHAR) - 1 AS j FROM p),
z AS (SELECT *, 1 + max(i) OVER (PARTITION BY locus) AS olds, 1 + max(j) OVER (PARTITION BY locus) AS news FROM q),
o AS (SELECT *, CASE WHEN news <= olds THEN (i - j + olds) % olds ELSE (j - i + news) % news END AS shift FROM z),
b AS (SELECT locus, shift, sum(bp) AS x1, sum(exact) AS x2, sum(ppm) AS x3, sum(span) AS x4, sum(near) AS x5 FROM o GROUP BY locus, shift),
w AS (SELECT locus, shift, row_number() OVER (PARTITION BY locus ORDER BY x1 DESC, x2 DESC, x3 DESC, x4 DESC, x5 DESC, shift) AS k FROM b)
SELECT o.locus, o.old_id::VARCHAR AS old_id, o.new_id::VARCHAR AS new_id FROM o JOIN w ON o.locus = w.locus AND o.shift = w.shift AND k = 1"""


@query(_ASSIGNED[: _ASSIGNED.index("z AS (")].rstrip().rstrip(",") + " SELECT locus, old_id::VARCHAR AS old_id, new_id::VARCHAR AS new_id, bp AS cds_bp, exact, ppm::BIGINT AS ppm, span, near FROM q")
def g07_lineage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What current and tool models of a place have in common: the vector by which lineage is assigned."""
    return lineage_scores(spark, sf_dir).drop("old_at", "new_at")


@query(_ASSIGNED.replace("SELECT o.locus, o.old_id::VARCHAR AS old_id, o.new_id::VARCHAR AS new_id FROM o", """SELECT o.locus, o.old_id::VARCHAR AS old_id, o.new_id::VARCHAR AS new_id,
  CASE WHEN olds = 1 AND news = 1 THEN 'one_to_one_lineage' ELSE CASE WHEN news > 1 AND olds = 1 THEN 'split' WHEN olds > 1 AND news = 1 THEN 'merge' ELSE 'complex' END || CASE WHEN bp > 0 THEN '_maximum_cds_contribution' WHEN span > 0 THEN '_maximum_span_fallback' ELSE '_genomic_order_fallback' END END AS basis,
  CASE WHEN olds = 1 AND news = 1 THEN 'deterministic_one_to_one_inheritance' WHEN bp > 0 THEN 'deterministic_cds_anchor' WHEN span > 0 THEN 'deterministic_span_fallback' ELSE 'deterministic_order_fallback' END AS status FROM o"""))
def g08_anchor_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On what each inherited identifier rests: the locus' relation, then coding, span, or order."""
    scores, _ = written(lineage_scores(spark, sf_dir), "lineage-scores")
    sides = scores.groupBy("locus").agg(F.count_distinct("old_id").alias("olds"), F.count_distinct("new_id").alias("news"))
    got = lineage.assign(scores, "locus", ["cds_bp", "exact", "ppm", "span", "near"]).join(sides, "locus").join(scores, ["locus", "old_id", "new_id"])
    relation = F.when((F.col("olds") == 1) & (F.col("news") == 1), "one_to_one_replacement").when(F.col("olds") == 1, "split_replacement").when(F.col("news") == 1, "merge_replacement").otherwise("complex_replacement")
    basis, status = lineage.anchor_status(relation, F.col("cds_bp"), F.col("span"))
    return got.select("locus", "old_id", "new_id", basis.alias("basis"), status.alias("status"))


@query(_ASSIGNED)
def g06_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one lineage per locus by the greatest score vector (G06 to G08); tests weigh all assignments of larger loci."""
    return lineage.assign(lineage_scores(spark, sf_dir), "locus", ["cds_bp", "exact", "ppm", "span", "near"])


@query()
def g09_positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for new models in the gaps between current ones of their sequence (G09, A27, J22); tests check the rule.

    One name space holds all sequences, as in an annotation whose identifiers don't name theirs.
    """
    t = transcripts(spark, sf_dir).select("tx_id", "seqid", "source", "start", "end")
    known = t.filter("source = 'current'").select("seqid", "start", text.numbered_id("GeneG", F.col("tx_id") * 10, 9).alias("gene_id"))
    new = t.filter("source = 'ToolA'").select(F.col("tx_id").cast("string").alias("new_id"), "seqid", "start", "end")
    return lineage.positional_ids(new, known, known.select("gene_id"))
