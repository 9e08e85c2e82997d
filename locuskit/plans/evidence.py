"""Junctions, protein hits, edges, loci and the rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules
from locuskit.operators import components, eligibility, evidence, islands, range_join
from locuskit.plans.registry import query
from locuskit.plans.views import exons, hits, introns, observed, transcripts
from locuskit.session import written


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merged_junctions(observed(spark, sf_dir))


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.supported(junctions(spark, sf_dir))


#: One strand rule, in SQL, between an intron i and a junction j.
_STRAND = "(i.strand = '.' OR j.strand = '.' OR i.strand = j.strand)"
_OK = ", ok AS MATERIALIZED (SELECT * FROM junction WHERE reads >= 3 AND samples >= 1)\n"


@query("SELECT seqid, s AS start, e AS \"end\", strand, reads, hang, samples, names FROM junction")
def a01_merge_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions(spark, sf_dir)


@query("SELECT seqid, s AS start, e AS \"end\", strand, reads FROM junction WHERE reads >= 3 AND samples >= 1")
def f05_supported_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported(spark, sf_dir).select("seqid", "start", "end", "strand", "reads")


@query("SELECT seqid, strand, sum(reads)::BIGINT AS reads, count(*) AS n FROM observed WHERE reads >= 25 GROUP BY ALL")
def f06_row_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other order: rows below the threshold go before anything is summed."""
    return observed(spark, sf_dir).filter("reads >= 25").groupBy("seqid", "strand").agg(F.sum("reads").alias("reads"), F.count("*").alias("n"))


@query("SELECT tx_id, hit_id, least(t.e, h.e) - greatest(t.s, h.s) + 1 AS bp FROM tx t JOIN hit h ON t.seqid = h.seqid AND t.s <= h.e AND h.s <= t.e")
def j02_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = range_join.overlap_join(transcripts(spark, sf_dir).select("tx_id", "seqid", "start", "end"), hits(spark, sf_dir), ["seqid"])
    return p.select("tx_id", F.col("hit_id_r").alias("hit_id"), intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r")).alias("bp"))


@query(", a AS (SELECT seqid, s AS x0, s + 100 * (tx_id % 7) * (tx_id % 11) * (tx_id % 13) AS x1, tx_id FROM tx), h AS (SELECT * FROM hit) SELECT tx_id, count(*) AS n FROM a JOIN h ON a.seqid = h.seqid AND x0 <= h.e AND h.s <= x1 GROUP BY tx_id")
def j02_mixed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals from one position to a hundred thousand: every level of bins is used."""
    t = F.col("tx_id")
    a = transcripts(spark, sf_dir).select("tx_id", "seqid", "start", (F.col("start") + 100 * (t % 7) * (t % 11) * (t % 13)).alias("end"))
    return range_join.overlap_join(a, hits(spark, sf_dir), ["seqid"]).groupBy("tx_id").agg(F.count("*").alias("n"))


_PAIR = """, ch AS MATERIALIZED (
  SELECT t.tx_id, t.tx_id // 4 AS w, any_value(t.seqid) AS seqid, any_value(t.strand) AS strand, any_value(t.s) AS s, any_value(t.e) AS e, any_value(x) AS x, coalesce(any_value(c), []) AS c, coalesce(any_value(g), []) AS g, coalesce(any_value(k), '') AS k
  FROM tx t LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e}) AS x FROM exon GROUP BY tx_id) USING (tx_id) LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e}) AS c FROM cds GROUP BY tx_id) USING (tx_id)
  LEFT JOIN (SELECT tx_id, list({'s': s, 'e': e}) AS g, string_agg(s || '-' || e, ',' ORDER BY s, e) AS k FROM intron GROUP BY tx_id) USING (tx_id) GROUP BY t.tx_id),
p AS MATERIALIZED (SELECT a.tx_id AS a, b.tx_id AS b, greatest((least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1), (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1)) AS share,
  len(list_filter(a.x, lambda u: len(list_filter(b.x, lambda v: u.s <= v.e AND v.s <= u.e)) > 0)) > 0 AS exons, len(list_filter(a.c, lambda u: len(list_filter(b.c, lambda v: u.s <= v.e AND v.s <= u.e)) > 0)) > 0 AS codes,
  len(list_filter(a.g, lambda u: len(list_filter(b.g, lambda v: u.s = v.s AND u.e = v.e)) > 0)) > 0 AS gaps, len(list_filter(a.g, lambda u: len(list_filter(b.g, lambda v: u.s = v.s OR u.e = v.e OR u.s = v.e OR u.e = v.s)) > 0)) > 0 AS sites,
  a.k = b.k AND a.k <> '' AS same, a.s <> b.s OR a.e <> b.e AS moved
  FROM ch a JOIN ch b ON a.w = b.w AND a.tx_id < b.tx_id WHERE a.s <= b.e AND b.s <= a.e AND (a.strand = b.strand OR a.strand = '.' OR b.strand = '.')),
edge AS MATERIALIZED (
  SELECT a, b, 'span_overlap' AS kind FROM p WHERE share >= 0.2 UNION ALL SELECT a, b, 'exon_overlap' FROM p WHERE exons UNION ALL SELECT a, b, 'CDS_overlap' FROM p WHERE codes
  UNION ALL SELECT a, b, 'identical_intron_chain' FROM p WHERE same UNION ALL SELECT a, b, 'terminal_boundary_difference_only' FROM p WHERE same AND moved
  UNION ALL SELECT a, b, 'shared_introns' FROM p WHERE gaps AND NOT same UNION ALL SELECT a, b, 'shared_splice_site' FROM p WHERE sites AND NOT same)
"""


@query(_PAIR + "SELECT a, b, kind FROM edge")
def j03_structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.structural_edges(transcripts(spark, sf_dir))


@query("SELECT tx_id AS a, n AS b FROM (SELECT tx_id, lead(tx_id) OVER (PARTITION BY source, gene_id ORDER BY tx_id) AS n FROM tx) WHERE n IS NOT NULL")
def j04_same_gene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gene_edges(exons(spark, sf_dir).select("tx_id", "source", "gene_id").distinct()).select("a", "b")


_BRIDGED = """, o AS MATERIALIZED (SELECT tx_id, t.strand, hit_id FROM tx t JOIN hit h ON t.seqid = h.seqid AND t.s <= h.e + 50 AND h.s - 50 <= t.e),
f AS (SELECT hit_id, strand, min(tx_id) AS k FROM o GROUP BY ALL), link AS (SELECT hit_id, tx_id AS a, lead(tx_id) OVER (PARTITION BY hit_id, strand ORDER BY tx_id) AS b FROM o
  UNION ALL SELECT x.hit_id, least(x.k, y.k), greatest(x.k, y.k) FROM f x JOIN f y ON x.hit_id = y.hit_id AND x.strand = '.' AND y.strand <> '.'), bridge AS (SELECT a, b, min(hit_id) AS hit_id FROM link WHERE b IS NOT NULL GROUP BY ALL)
"""


@query(_BRIDGED + "SELECT a, b, hit_id FROM bridge")
def j05_protein_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that overlap one hit, or come near it, on strands that go together."""
    return evidence.protein_bridges(transcripts(spark, sf_dir), hits(spark, sf_dir), flank=50).select("a", "b", "hit_id")


_WIDE = ", wide AS (SELECT s, e + 700 AS e, strand FROM junction)\n"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer junctions on one sequence, so that some reach from one window into the next."""
    return junctions(spark, sf_dir).select(F.lit("all").alias("seqid"), "start", (F.col("end") + 700).alias("end"), "strand")


@query(_WIDE + """, g AS (SELECT a.tx_id AS a, b.tx_id AS b, a.s AS l0, a.e AS l1, b.s AS r0, b.e AS r1, a.strand AS s1, b.strand AS s2 FROM tx a JOIN tx b ON b.tx_id // 4 - 1 = a.tx_id // 4 AND a.e < b.s AND b.s - a.e - 1 <= 700
  AND (a.strand = b.strand OR a.strand = '.' OR b.strand = '.'))
SELECT a, b, min({'s': j.s, 'e': j.e}).s AS start, min({'s': j.s, 'e': j.e}).e AS "end" FROM g JOIN wide j ON j.s // 1000 = l0 // 1000 AND (abs(j.s - l1) <= 30 OR j.s BETWEEN l0 AND l1) AND (abs(j.e - r0) <= 30 OR j.e BETWEEN r0 AND r1)
  AND j.s < j.e AND j.s <= r0 + 30 AND j.e >= l1 - 30 AND (j.strand = '.' OR s1 = '.' OR s2 = '.' OR j.strand = s1 OR j.strand = s2) GROUP BY a, b""")
def j06_junction_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).withColumn("seqid", F.lit("all"))
    return evidence.junction_bridges(t, _wide(spark, sf_dir), window=700).select("a", "b", "start", "end")


_SUM = "coalesce(list_sum(flatten(list_transform(a.{0}, lambda u: list_transform(b.{0}, lambda v: greatest(0, least(u.e, v.e) - greatest(u.s, v.s) + 1))))), 0)::BIGINT"
_TYPED = _PAIR.rstrip() + _BRIDGED.rstrip() + f""", q AS MATERIALIZED (SELECT a.tx_id AS a, b.tx_id AS b, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS bp, a.e - a.s + 1 AS la, b.e - b.s + 1 AS lb, {_SUM.format("x")} AS xb, {_SUM.format("c")} AS cb, len(a.g) AS n,
    len(list_filter(a.g, lambda u: len(list_filter(b.g, lambda v: u.s = v.s AND u.e = v.e)) > 0)) AS gb, len(list_intersect(list_distinct(flatten(list_transform(a.g, lambda u: [u.s, u.e]))), list_distinct(flatten(list_transform(b.g, lambda u: [u.s, u.e]))))) AS sb, a.k = b.k AND a.k <> '' AS same, a.s <> b.s OR a.e <> b.e AS moved
  FROM ch a JOIN ch b ON a.w = b.w AND a.tx_id < b.tx_id WHERE a.s <= b.e AND b.s <= a.e AND (a.strand = b.strand OR a.strand = '.' OR b.strand = '.')),
rna AS (SELECT a.tx_id AS a, b.tx_id AS b, a.seqid, min({{'s': j.s, 'e': j.e, 'd': j.strand, 'r': j.reads, 'n': j.samples}}) AS j FROM tx a JOIN tx b ON a.tx_id // 4 = b.tx_id // 4 AND a.e < b.s AND b.s - a.e - 1 <= 500 AND (a.strand = b.strand OR a.strand = '.' OR b.strand = '.')
  JOIN junction j ON j.seqid = a.seqid AND j.s // 1000 = a.s // 1000 AND (abs(j.s - a.e) <= 30 OR j.s BETWEEN a.s AND a.e) AND (abs(j.e - b.s) <= 30 OR j.e BETWEEN b.s AND b.e) AND j.s < j.e AND (j.strand IN ('.', a.strand, b.strand) OR a.strand = '.' OR b.strand = '.') GROUP BY ALL),
typed AS (SELECT a, b, 'span_overlap' AS edge_type, 'moderate' AS edge_strength, 'overlap_bp=' || bp || ';frac_a=' || format('{{:.4f}}', bp / la) || ';frac_b=' || format('{{:.4f}}', bp / lb) AS evidence_detail FROM q WHERE greatest(bp / la, bp / lb) >= 0.2
  UNION ALL SELECT a, b, 'exon_overlap', 'strong', 'overlap_bp=' || xb FROM q WHERE xb > 0 UNION ALL SELECT a, b, 'CDS_overlap', 'strong', 'overlap_bp=' || cb FROM q WHERE cb > 0 UNION ALL SELECT a, b, 'identical_intron_chain', 'strong', 'intron_count=' || n FROM q WHERE same
  UNION ALL SELECT a, b, 'shared_introns', 'strong', 'shared_intron_count=' || gb FROM q WHERE gb > 0 AND NOT same UNION ALL SELECT a, b, 'shared_splice_site', 'moderate', 'shared_site_count=' || sb FROM q WHERE sb > 0 AND NOT same
  UNION ALL SELECT a, b, 'terminal_boundary_difference_only', 'moderate', 'same_intron_chain_with_different_span' FROM q WHERE same AND moved
  UNION ALL SELECT a, b, 'same_source_gene', 'strong', 'source=' || source || ';gene_id=' || gene_id FROM (SELECT tx_id AS a, lead(tx_id) OVER (PARTITION BY source, gene_id ORDER BY tx_id) AS b, source, gene_id FROM tx) WHERE b IS NOT NULL
  UNION ALL SELECT a, b, 'protein_bridge', 'moderate', 'protein_hit=' || hit_id || ';target=' FROM bridge
  UNION ALL SELECT a, b, 'RNA_junction_bridge', 'strong', seqid || ':' || j.s || '-' || j.e || ':' || j.d || ';support=' || j.r || ';samples=' || j.n FROM rna)
SELECT least(a::VARCHAR, b::VARCHAR) AS model_id_a, greatest(a::VARCHAR, b::VARCHAR) AS model_id_b, edge_type, edge_strength, x.seqid, CASE WHEN x.strand = y.strand THEN x.strand ELSE 'compatible_or_mixed' END AS strand, evidence_detail FROM typed JOIN tx x ON x.tx_id = a JOIN tx y ON y.tx_id = b"""


@query(_TYPED)
def g01_unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of edges between models with their strength and what they rest on."""
    return evidence.unit_edges(transcripts(spark, sf_dir), hits(spark, sf_dir), junctions(spark, sf_dir), flank=50)


@query(_OK + f"""SELECT tx_id, s AS start, e AS "end", EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.s = i.s AND j.e = i.e AND {_STRAND}) AS exact,
  EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.s = i.s AND {_STRAND}) AS donor, EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.e = i.e AND {_STRAND}) AS acceptor FROM intron i""")
def j07_intron_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and one-ended support."""
    return evidence.exactly_supported(introns(spark, sf_dir), supported(spark, sf_dir)).select("tx_id", "start", "end", "exact", "donor", "acceptor")


@query(_OK + f"""SELECT tx_id, start, "end", array_to_string(list_sort(list(x))[1:20], ';') AS near FROM (SELECT DISTINCT tx_id, i.s AS start, i.e AS "end", j.seqid || ':' || j.s || '-' || j.e || ':' || j.strand AS x FROM intron i JOIN ok j ON i.seqid = j.seqid
  AND (i.strand = '.' OR j.strand = '.' OR i.strand = j.strand) AND NOT (i.s = j.s AND i.e = j.e) AND (abs(i.s - j.s) <= 60 OR abs(i.e - j.e) <= 60) ) GROUP BY ALL""")
def j09_nearby_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = introns(spark, sf_dir).select("tx_id", "seqid", "strand", "start", "end")
    return evidence.listed_near(all_, supported(spark, sf_dir), window=60).select("tx_id", "start", "end", "near")


@query("SELECT tx_id, count(*) AS hits, (max({'bp': bp, 'h': -hit_id})).bp AS best_bp, -(max({'bp': bp, 'h': -hit_id})).h AS best_hit FROM (SELECT tx_id, hit_id, least(t.e, h.e) - greatest(t.s, h.s) + 1 AS bp FROM tx t JOIN hit h ON t.seqid = h.seqid AND t.s <= h.e AND h.s <= t.e) GROUP BY tx_id")
def j11_protein_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.protein_support(transcripts(spark, sf_dir), hits(spark, sf_dir), "tx_id")


@query(", c AS (SELECT tx_id, seqid, s, e FROM tx WHERE source = 'current') SELECT t.tx_id, c.tx_id AS current_id FROM (SELECT t.tx_id, (max({'bp': least(t.e, c.e) - greatest(t.s, c.s) + 1, 'i': -c.tx_id})).i AS i FROM tx t JOIN c ON t.seqid = c.seqid AND t.s <= c.e AND c.s <= t.e WHERE t.source <> 'current' GROUP BY t.tx_id) t JOIN c ON c.tx_id = -t.i")
def j20_best_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).select("tx_id", "seqid", "source", "start", "end")
    p = range_join.overlap_join(t.filter("source <> 'current'"), t.filter("source = 'current'"), ["seqid"])
    bp = intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    return p.groupBy("tx_id").agg(F.min(F.struct(-bp, F.col("tx_id_r"))).alias("m")).select("tx_id", F.col("m.tx_id_r").alias("current_id"))


@query("SELECT a.tx_id AS a, b.tx_id AS b, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS bp FROM (SELECT tx_id, CASE source WHEN 'current' THEN 'current' ELSE 'Tool' END AS source, seqid, gene_id, s, e, strand FROM tx) a JOIN (SELECT tx_id, CASE source WHEN 'current' THEN 'current' ELSE 'Tool' END AS source, seqid, gene_id, s, e, strand FROM tx) b ON a.source = b.source AND a.seqid = b.seqid AND a.strand = b.strand AND a.gene_id <> b.gene_id AND a.tx_id < b.tx_id AND a.s <= b.e AND b.s <= a.e WHERE (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1) >= 0.9 OR (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1) >= 0.9")
def j19_neighbour_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).withColumn("source", F.when(F.col("source") == "current", "current").otherwise("Tool"))
    return evidence.neighbour_conflicts(t)


_ELIGIBLE = """, t AS (SELECT tx_id, CASE source WHEN 'current' THEN 'current' ELSE 'Tool' END AS src, seqid, gene_id, s, e, strand FROM tx),
p AS (SELECT a.tx_id, b.tx_id AS other, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS bp FROM t a JOIN t b ON a.src = b.src AND a.seqid = b.seqid AND a.strand = b.strand AND a.gene_id <> b.gene_id AND a.tx_id <> b.tx_id AND a.s <= b.e AND b.s <= a.e
  WHERE (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1) >= 0.9 OR (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1) >= 0.9),
h AS (SELECT tx_id, list('same_source_different_gene_high_overlap:' || other || ':overlap_bp_' || bp) AS l FROM p GROUP BY tx_id)
SELECT t.tx_id, array_to_string(list_sort(list_concat(coalesce(l, []), CASE WHEN t.tx_id % 9 = 0 THEN ['no_CDS_features'] ELSE [] END)), ';') AS hard, l IS NULL AND t.tx_id % 9 > 0 AS eligible, CASE WHEN l IS NULL AND t.tx_id % 9 > 0 THEN 'pass' ELSE 'fail' END AS status FROM t LEFT JOIN h ON h.tx_id = t.tx_id"""


@query(_ELIGIBLE)
def r04_eligible_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one source that share nearly all of their place, added to the hard reasons of an audit."""
    t = transcripts(spark, sf_dir).withColumn("source", F.when(F.col("source") == "current", "current").otherwise("Tool"))
    hard = F.when(F.col("tx_id") % 9 == 0, F.array(F.lit("no_CDS_features"))).otherwise(F.array().cast("array<string>"))
    audit = t.select("tx_id", hard.alias("hard")).select("*", F.when(F.size("hard") > 0, "fail").otherwise("pass").alias("status"), (F.size("hard") == 0).alias("eligible"))
    told = eligibility.with_conflicts(audit, evidence.neighbour_conflicts(t), "tx_id")
    return told.select("tx_id", F.array_join("hard", ";").alias("hard"), "eligible", "status")


@query(", c AS (SELECT seqid, s, max(tx_id) AS i FROM tx WHERE source = 'current' GROUP BY ALL) SELECT tx_id, (SELECT max_by(i, c.s) FROM c WHERE c.seqid = t.seqid AND c.s <= t.s) AS before, (SELECT min_by(i, c.s) FROM c WHERE c.seqid = t.seqid AND c.s > t.s) AS after FROM tx t WHERE source = 'ToolA'")
def j22_as_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current models before and after each tool model: one sort each, no join."""
    t = transcripts(spark, sf_dir).select("tx_id", "seqid", "source", "start")
    anchors = t.filter("source = 'current'").groupBy("seqid", "start").agg(F.max("tx_id").alias("anchor"))
    one = islands.as_of(t.filter("source = 'ToolA'"), anchors, ["seqid"], "start", "anchor")
    two = islands.as_of(one, anchors, ["seqid"], "start", "anchor", after=True)
    return two.select("tx_id", F.col("last_value").alias("before"), F.col("next_value").alias("after"))


@query(_OK + f""", f AS (SELECT i.*, EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.s = i.s AND j.e = i.e AND {_STRAND}) AS x,
  EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.s = i.s AND {_STRAND}) AS d, EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.e = i.e AND {_STRAND}) AS a FROM intron i)
SELECT tx_id, count(*) AS introns, count(*) FILTER (x) AS supported, bool_and(d) AS donor_supported, bool_and(a) AS acceptor_supported, bool_and(x) AS full_chain,
  coalesce(string_agg(s || '-' || e, ';' ORDER BY s, e) FILTER (NOT x), '') AS unsupported FROM f GROUP BY tx_id""")
def a07_model_junction_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: merged junctions, introns of all models, support per model."""
    return evidence.model_support(introns(spark, sf_dir), supported(spark, sf_dir), ["tx_id"])


_STATUS = _OK + f""", f AS (SELECT i.*, EXISTS (SELECT 1 FROM ok j WHERE j.seqid = i.seqid AND j.s = i.s AND j.e = i.e AND {_STRAND}) AS x FROM intron i),
n AS (SELECT i.tx_id, i.s, i.e, j.s AS js, j.e AS je, row_number() OVER (PARTITION BY i.tx_id, i.s, i.e ORDER BY samples DESC, reads DESC, j.s, j.e, j.strand) AS k FROM f i JOIN ok j ON NOT x AND i.seqid = j.seqid
  AND i.s - 20 <= j.e AND j.s <= i.e + 20 AND {_STRAND} AND NOT (i.s = j.s AND i.e = j.e)),
c AS (SELECT tx_id, count(*) AS conflicting, sum(alt)::BIGINT AS alternatives FROM (SELECT tx_id, s, e, count(*) FILTER (NOT (abs(js - s) <= 30 AND abs(je - e) <= 30)) AS alt FROM n WHERE k <= 5 GROUP BY ALL) GROUP BY tx_id),
st AS (SELECT tx_id, source, coalesce(introns, 0) AS introns, coalesce(exact, 0) AS exact, coalesce(conflicting, 0) AS conflicting, coalesce(alternatives, 0) AS alternatives,
  CASE WHEN introns IS NULL THEN 'not_assessable' WHEN conflicting > 0 THEN 'conflicting_junction' WHEN exact = introns THEN 'full_junction_support' WHEN exact > 0 THEN 'partial_junction_support' ELSE 'none_observed' END AS status
  FROM tx LEFT JOIN (SELECT tx_id, count(*) AS introns, count(*) FILTER (x) AS exact FROM f GROUP BY tx_id) USING (tx_id) LEFT JOIN c USING (tx_id))
"""


def _status_of(spark: SparkSession, sf_dir: str, models: DataFrame) -> DataFrame:
    gaps = models.select("tx_id", "seqid", "strand", F.explode("gaps").alias("g")).select("tx_id", "seqid", "strand", "g.*")
    return evidence.arbitration_status(models, gaps, supported(spark, sf_dir), "tx_id", window=20)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status_of(spark, sf_dir, written(transcripts(spark, sf_dir).select("tx_id", "seqid", "strand", "gaps"), "models")[0])


@query(_STATUS + "SELECT tx_id, introns, exact, conflicting, alternatives, status FROM st")
def a08_junction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, conflicting and alternative junctions of each model and its status."""
    return status(spark, sf_dir)


_EVIDENCE = _STATUS + """, ph AS (SELECT tx_id, count(*) AS hits FROM tx t JOIN hit h ON t.seqid = h.seqid AND t.s <= h.e AND h.s <= t.e GROUP BY tx_id),
cc AS (SELECT tx_id, count(*) AS coding FROM cds GROUP BY tx_id),
ev AS (SELECT st.*, coalesce(hits, 0) AS hits, coalesce(coding, 0) AS coding FROM st LEFT JOIN ph USING (tx_id) LEFT JOIN cc USING (tx_id))
"""


def model_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model with its junction status, protein hits, number of coding blocks and exons."""
    t, _ = written(transcripts(spark, sf_dir), "models")
    one = _status_of(spark, sf_dir, t).join(evidence.protein_support(t, hits(spark, sf_dir), "tx_id").select("tx_id", "hits"), "tx_id", "left")
    return t.select("tx_id", "seqid", "source", "strand", "gene_id", "start", "end", "gaps", F.size("coding").alias("coding"), F.size("blocks").alias("n_exons")).join(one, "tx_id").withColumn("hits", F.coalesce("hits", F.lit(0)))


@query(_EVIDENCE + """SELECT tx_id, array_to_string(list_sort(list_filter([CASE WHEN status = 'full_junction_support' THEN 'all_introns_junction_supported' END, CASE WHEN status = 'partial_junction_support' THEN 'partial_introns_junction_supported' END,
  CASE WHEN hits > 0 THEN 'protein_overlap_present' END, CASE WHEN coding > 0 THEN 'CDS_present' END], lambda x: x IS NOT NULL)), ',') AS flags,
  array_to_string(list_sort(list_filter([CASE status WHEN 'conflicting_junction' THEN 'conflicting_RNA_junction' WHEN 'none_observed' THEN 'RNA_junction_none_observed_not_negative_evidence'
    WHEN 'not_assessable' THEN CASE WHEN introns > 0 THEN 'RNA_junction_not_assessable' ELSE 'single_exon_model_no_splice_junction_to_assess' END END,
  CASE WHEN alternatives > 0 THEN 'nearby_alternative_junctions' END, CASE WHEN hits = 0 THEN 'protein_evidence_none_observed' END, CASE WHEN coding = 0 THEN 'no_CDS_features' END], lambda x: x IS NOT NULL)), ',') AS risks,
  CASE WHEN source = 'current' THEN 'base_model_candidate' WHEN status IN ('full_junction_support', 'partial_junction_support') OR hits > 0 THEN 'supported_alternative_candidate' ELSE 'available_candidate_needs_validation' END AS role FROM ev""")
def r05_model_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_evidence(spark, sf_dir)
    flags, risks, role = rules.model_evidence(*[F.col(c) for c in ("status", "introns", "alternatives", "hits", "coding", "n_exons", "source")])
    return m.select("tx_id", rules.joined(flags).alias("flags"), rules.joined(risks).alias("risks"), role.alias("role"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, root: models of a locus by structural edges."""
    t = transcripts(spark, sf_dir)
    return components.components(t.select(F.col("tx_id").alias("node")), evidence.structural_edges(t).select("a", "b"))


def _recursive(rest: str) -> str:
    from locuskit.plans.views import SQL

    return SQL.replace("WITH exon", "WITH RECURSIVE exon", 1).rstrip().rstrip(",") + _PAIR + """, twoway AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT tx_id AS node, tx_id AS other FROM tx UNION SELECT r.node, twoway.b FROM reach r JOIN twoway ON r.other = twoway.a),
locus AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
""" + rest


@query(_recursive("SELECT node, root FROM locus"), views=False)
def g02_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci(spark, sf_dir)


@query(_recursive("SELECT 'locus_' || lpad(k::VARCHAR, 8, '0') AS locus_id, root, seqid, start, \"end\", models, sources, genes FROM (SELECT root, seqid, min(s) AS start, max(e) AS \"end\", count(*) AS models, count(DISTINCT source) AS sources, count(DISTINCT gene_id) AS genes, row_number() OVER (ORDER BY min({'q': seqid, 's': s, 'e': e, 't': tx_id})) AS k FROM locus JOIN tx ON tx_id = node GROUP BY root, seqid)"), views=False)
def a06_locus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci numbered by their first model, with counts."""
    t = transcripts(spark, sf_dir).select(F.col("tx_id").alias("node"), "seqid", "source", "gene_id", "start", "end")
    units = t.join(loci(spark, sf_dir), "node").groupBy("root", "seqid").agg(
        F.min(F.struct("start", "end", "node")).alias("first"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("models"), F.count_distinct("source").alias("sources"), F.count_distinct("gene_id").alias("genes"),
    )
    from locuskit.functions.text import numbered_id

    made = islands.numbered(written(units, "loci")[0], ["first"], "k", ["seqid", F.floor(F.col("first.start") / islands.BIN)])
    return made.select(numbered_id("locus_", F.col("k"), 8).alias("locus_id"), "root", "seqid", "start", "end", "models", "sources", "genes")


@query(_recursive("""SELECT root, CASE WHEN span > 1000 THEN 'complex_risk_flagged' WHEN len(r) > 0 THEN 'ai_arbitrable_complex' ELSE 'auto_arbitration_eligible' END AS class, array_to_string(list_sort(r), ',') AS reasons FROM (
  SELECT root, span, list_filter([CASE WHEN models > 3 THEN 'many_candidate_models_AI_arbitrable' END, CASE WHEN chains > 2 THEN 'many_unique_structures_AI_arbitrable' END, CASE WHEN per > 1 THEN 'multi_gene_source_set_arbitration' END,
    CASE WHEN cur > 1 AND tool > 1 AND per > 1 THEN 'multi_current_multi_tool_gene_set_arbitration' END, CASE WHEN span > 1000 THEN 'locus_span_too_large' END], lambda x: x IS NOT NULL) AS r FROM (
    SELECT root, max(e) - min(s) + 1 AS span, count(*) AS models, count(DISTINCT k) AS chains, count(*) FILTER (source = 'current') AS cur, count(*) FILTER (source <> 'current') AS tool FROM locus JOIN tx ON tx_id = node JOIN (SELECT tx_id, k FROM ch) USING (tx_id) GROUP BY root)
  JOIN (SELECT root, max(g) AS per FROM (SELECT root, source, count(DISTINCT gene_id) AS g FROM locus JOIN tx ON tx_id = node GROUP BY ALL) GROUP BY root) USING (root))"""), views=False)
def r08_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct structures and genes of a locus and its class."""
    t = transcripts(spark, sf_dir).select(F.col("tx_id").alias("node"), "source", "gene_id", "start", "end", intervals.shown(F.col("gaps")).alias("chain")).join(loci(spark, sf_dir), "node")
    per_source = t.groupBy("root", "source").agg(F.count_distinct("gene_id").alias("g")).groupBy("root").agg(F.max("g").alias("per"))
    whole = t.groupBy("root").agg(
        (F.max("end") - F.min("start") + 1).alias("span"), F.count("*").alias("models"), F.count_distinct("chain").alias("chains"), F.count_if(F.col("source") == "current").alias("cur"), F.count_if(F.col("source") != "current").alias("tool"),
    )
    name, reasons = rules.complexity(F.col("models"), F.col("chains"), F.col("per"), F.col("span"), F.col("cur"), F.col("tool"), most=(3, 2, 1, 1000))
    return whole.join(per_source, "root").select("root", name.alias("class"), rules.joined(reasons).alias("reasons"))


@query(_EVIDENCE.rstrip() + """
SELECT tx_id // 4 AS w, source, count(*) AS models, min(tx_id) AS first, count(*) FILTER (status = 'full_junction_support') AS "full", count(*) FILTER (status = 'partial_junction_support') AS "partial",
  count(*) FILTER (status = 'conflicting_junction') AS conflict, count(*) FILTER (hits > 0) AS protein, count(*) FILTER (coding > 0) AS coding FROM ev GROUP BY ALL""")
def a03_model_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a source in a locus as one set with its counts."""
    m = model_evidence(spark, sf_dir).withColumn("w", F.floor(F.col("tx_id") / 4))
    has = lambda c: F.count_if(c)
    return m.groupBy("w", "source").agg(
        F.count("*").alias("models"), F.min("tx_id").alias("first"), has(F.col("status") == "full_junction_support").alias("full"), has(F.col("status") == "partial_junction_support").alias("partial"),
        has(F.col("status") == "conflicting_junction").alias("conflict"), has(F.col("hits") > 0).alias("protein"), has(F.col("coding") > 0).alias("coding"),
    )


@query(", ch AS (SELECT tx_id // 4 AS w, source, coalesce((SELECT string_agg(s || '-' || e, ',' ORDER BY s, e) FROM intron i WHERE i.tx_id = t.tx_id), '') AS c FROM tx t), k AS (SELECT w, c, count(DISTINCT source) AS sources, min(CASE source WHEN 'current' THEN 0 WHEN 'ToolA' THEN 1 WHEN 'ToolB' THEN 2 ELSE 3 END) AS best, string_agg(DISTINCT source, ',' ORDER BY source) AS members FROM ch GROUP BY w, c) SELECT w, row_number() OVER (PARTITION BY w ORDER BY best) AS set_no, sources, members FROM k")
def a04_structure_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of equal structure collapsed, the source of highest priority first."""
    from pyspark.sql import Window as W

    rank = F.array_position(F.array(*[F.lit(s) for s in ("current", "ToolA", "ToolB", "ToolC")]), F.col("source"))
    t = transcripts(spark, sf_dir).select(F.floor(F.col("tx_id") / 4).alias("w"), "source", intervals.shown(F.col("gaps")).alias("c"), rank.alias("rank"))
    k = t.groupBy("w", "c").agg(F.count_distinct("source").alias("sources"), F.min("rank").alias("best"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("members"))
    return k.select("w", F.row_number().over(W.partitionBy("w").orderBy("best")).cast("long").alias("set_no"), "sources", "members")


@query(", x AS (SELECT gene_id, s, e FROM cds), q AS (SELECT a.gene_id AS a, b.gene_id AS b, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM (SELECT DISTINCT gene_id, seqid, s, e FROM cds WHERE tx_id % 4 = 0) a JOIN (SELECT DISTINCT gene_id, seqid, s, e FROM cds WHERE tx_id % 4 = 1) b ON a.seqid = b.seqid AND a.s <= b.e AND b.s <= a.e) SELECT a, b, sum(least(e1, e2) - greatest(s1, s2) + 1)::BIGINT AS bp FROM q GROUP BY a, b")
def j27_block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared coding positions of current and tool genes, summed over pairs of blocks."""
    blocks = transcripts(spark, sf_dir).select("tx_id", "gene_id", "seqid", F.explode("coding").alias("b")).select("tx_id", "gene_id", "seqid", "b.*")
    side = lambda k: blocks.filter(f"tx_id % 4 = {k}").select("gene_id", "seqid", "start", "end").distinct()
    p = range_join.overlap_join(side(0), side(1), ["seqid"])
    return p.groupBy(F.col("gene_id").alias("a"), F.col("gene_id_r").alias("b")).agg(F.sum(intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))).alias("bp"))


@query("SELECT tx_id, NOT EXISTS (SELECT 1 FROM cds c WHERE c.tx_id = t.tx_id AND NOT EXISTS (SELECT 1 FROM exon x WHERE x.tx_id = c.tx_id AND x.exon_no % 3 > 0 AND x.s <= c.s AND c.e <= x.e)) AS nested FROM tx t")
def f18_coding_in_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = exons(spark, sf_dir).groupBy("tx_id").agg(F.collect_list(F.when(F.col("exon_no") % 3 > 0, F.struct("start", "end"))).alias("outer"))
    return transcripts(spark, sf_dir).select("tx_id", "coding").join(some, "tx_id").select("tx_id", intervals.nested(F.col("coding"), F.col("outer")).alias("nested"))


@query(", r AS (SELECT 'chr' || (n_nationkey % 5) AS seqid, n_nationkey * 20000 + 1 AS s, n_nationkey * 20000 + 9000 AS e FROM nation) SELECT tx_id FROM tx t WHERE EXISTS (SELECT 1 FROM r WHERE r.seqid = t.seqid AND r.s - 500 <= t.e AND t.s <= r.e + 500) OR gene_id IN (SELECT 'g' || c_custkey FROM customer WHERE c_custkey % 50 = 0)")
def f01_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that are named or lie in a region, flank included."""
    from locuskit.plans.views import table

    n = table(spark, sf_dir, "nation")
    regions = n.select(F.concat(F.lit("chr"), (F.col("n_nationkey") % 5).cast("string")).alias("seqid"), (F.col("n_nationkey") * 20000 + 1).cast("long").alias("start"), (F.col("n_nationkey") * 20000 + 9000).cast("long").alias("end"))
    wanted = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 0").select(F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("gene_id"))
    t = transcripts(spark, sf_dir).select("tx_id", "gene_id", "seqid", "start", "end")
    return range_join.overlap_join(t, regions, ["seqid"], widen=500).select("tx_id").union(t.join(wanted, "gene_id", "left_semi").select("tx_id")).distinct()
