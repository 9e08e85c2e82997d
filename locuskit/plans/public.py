"""Interval index, normaliser, public cards and aliases over projections of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.operators import normalise, public_cards, range_join
from locuskit.plans.registry import query
from locuskit.plans.views import exons, hits, transcripts


@query("SELECT hit_id, tx_id, exon_no FROM hit JOIN exon ON hit.seqid = exon.seqid AND hit.s - 100 <= exon.e AND exon.s <= hit.e + 100")
def j01_interval_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons listed once in an index by bins, probed by protein hits with a flank."""
    index = range_join.IntervalIndex.build(exons(spark, sf_dir).select("tx_id", "exon_no", "seqid", "start", "end"), ["seqid"], f"exons_{uuid.uuid4().hex}")
    return index.probe(hits(spark, sf_dir).select("hit_id", "seqid", "start", "end"), 100).select("hit_id", F.col("tx_id_r").alias("tx_id"), F.col("exon_no_r").alias("exon_no"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files, one a source: genes of some customers, transcripts of which every fifth names no parent, their exons; every
    seventh transcript is named by its exons alone."""
    t, x = transcripts(spark, sf_dir), exons(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    row = lambda df, at, feature, start, end, attrs: df.select(F.col("source").alias("file"), at.cast("long").alias("row_idx"), "seqid", F.lit("s").alias("source"), F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), F.lit(".").alias("score"), "strand", F.lit(".").alias("phase"), attrs.alias("attributes"))
    genes = t.filter("substr(gene_id, 2) % 2 = 0").groupBy("source", "gene_id", "seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.min("tx_id").alias("tx_id"))
    tx = t.filter("tx_id % 7 > 0")
    parent = F.when(F.col("tx_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(";Parent="), "gene_id"))
    return (
        row(genes, F.col("tx_id"), "gene", F.col("start"), F.col("end"), F.concat(F.lit("ID="), "gene_id"))
        .union(row(tx, F.col("tx_id") + 10**9, "mRNA", F.col("start"), F.col("end"), F.concat(F.lit("ID=x"), s("tx_id"), F.lit(".t1"), parent)))
        .union(row(x, F.col("tx_id") * 10 + F.col("exon_no") + 2 * 10**9, "exon", F.col("start"), F.col("end"), F.concat(F.lit("Parent=x"), s("tx_id"), F.lit(".t1"))))
    )


_NORMALISED = """, g AS (SELECT DISTINCT source, gene_id FROM tx WHERE substr(gene_id, 2)::BIGINT % 2 = 0), rowg AS (SELECT count(*) AS n, source FROM (SELECT DISTINCT source, gene_id, seqid FROM tx WHERE substr(gene_id, 2)::BIGINT % 2 = 0) GROUP BY source),
h AS (SELECT source, tx_id, CASE WHEN tx_id % 7 = 0 OR tx_id % 5 = 0 THEN 'x' || tx_id ELSE gene_id END AS gene, tx_id % 7 > 0 AND tx_id % 5 = 0 AS orphan, tx_id % 7 > 0 AS listed FROM tx),
every AS (SELECT source, gene FROM h UNION SELECT source, gene_id FROM g)
SELECT e.source AS file, e.n AS gene_count, t.n AS transcript_count, t.o AS orphan_transcripts_fixed, e.n - rg.g AS inferred_gene_count, rowg.n AS original_gene_features, t.m AS original_mrna_features, x.n AS original_exon_features, 0::BIGINT AS original_cds_features
FROM (SELECT source, count(*) AS n FROM every GROUP BY source) e JOIN (SELECT source, count(*) AS n, count(*) FILTER (orphan) AS o, count(*) FILTER (listed) AS m FROM h GROUP BY source) t ON t.source = e.source
JOIN (SELECT source, count(*) AS g FROM g GROUP BY source) rg ON rg.source = e.source JOIN rowg ON rowg.source = e.source JOIN (SELECT source, count(*) AS n FROM exon GROUP BY source) x ON x.source = e.source"""


@query(_NORMALISED)
def r42_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the normaliser counts and mends in each of several files."""
    rows = _rows(spark, sf_dir)
    genes, tx, _ = normalise.hierarchy(rows)
    return normalise.counts(rows, genes, tx)


_FEATURES = """, h AS (SELECT source, tx_id, seqid, s, e, strand, CASE WHEN tx_id % 7 = 0 OR tx_id % 5 = 0 THEN 'x' || tx_id ELSE gene_id END AS gene FROM tx)
SELECT source AS file, 'mRNA' AS feature, s AS "start", e AS "end", 'ID=x' || tx_id || '.t1;Parent=' || gene || ';Name=x' || tx_id || '.t1;source_name=' || source AS attributes FROM h
UNION ALL SELECT source, 'exon', s, e, 'ID=x' || tx_id || '.t1.exon.' || row_number() OVER (PARTITION BY tx_id ORDER BY s, e, exon_no) || ';Parent=x' || tx_id || '.t1' FROM exon"""


@query(_FEATURES)
def k04_normalised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts and numbered exons of the normalised files."""
    made = normalise.features(*normalise.hierarchy(_rows(spark, sf_dir)))
    return made.filter("feature <> 'gene'").select("file", "feature", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "attributes")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = transcripts(spark, sf_dir).withColumns({"locus_id": F.floor(F.col("tx_id") / 4), "pos": (F.col("tx_id") % 4).cast("int"), "model_id": F.concat_ws(":", "source", "gene_id", F.col("tx_id").cast("string"))})
    tags = F.array(F.concat(F.lit("near_"), F.lower("source")), F.lit(""), F.lit("not_available_for_de_novo_model"), F.lit("b"), F.when(F.col("tx_id") % 3 == 0, "a").otherwise("b"))
    models = t.select("locus_id", "pos", "model_id", "source", tags.alias("risk_tags"), F.array("strand").alias("hard_flags"), F.size("blocks").alias("exon_count"))
    sets = t.select("locus_id", "pos", F.concat(F.lit("set_"), "source").alias("set_id"), "source", F.array("model_id", F.lit("absent")).alias("model_ids"), tags.alias("risk_tags"), F.array("strand").alias("hard_flags"), F.array("source", F.lit("ToolX")).alias("supporting_sources"), F.array().cast("array<string>").alias("equivalent_source_set_ids"), F.lit(1).alias("gene_count"))
    return sets, models


_CARDS = """, m AS (SELECT tx_id // 4 AS locus, source, tx_id, strand, n, row_number() OVER (PARTITION BY tx_id // 4, source = 'current' ORDER BY tx_id) AS k FROM tx),
a AS (SELECT *, CASE WHEN source = 'current' THEN 'current_set' ELSE 'candidate_set_' || chr((64 + k)::INTEGER) END AS sid, CASE WHEN source = 'current' THEN 'current_model_' ELSE 'candidate_model_' END || lpad(k::VARCHAR, 2, '0') AS mid,
  '[' || CASE WHEN tx_id % 3 = 0 THEN '"a",' ELSE '' END || '"b","near_' || lower(source) || '"]' AS tags FROM m),
s AS (SELECT locus, string_agg('{"candidate_label":"' || CASE WHEN source = 'current' THEN 'current' ELSE replace(sid, 'candidate_set_', 'candidate_') END || '","equivalent_source_set_count":0,"equivalent_source_set_ids":[],"gene_count":1,"hard_flags":["' || strand || '"],"model_ids":["' || mid || '"],"representative_source":"source_01","risk_tags":' || tags
    || ',"set_id":"' || sid || '","set_role":"' || CASE WHEN source = 'current' THEN 'current' ELSE 'candidate' END || '_gene_set","supporting_source_count":2,"supporting_sources":["source_01","source_02"]}', ',' ORDER BY sid) AS sets,
  string_agg('{"exon_count":' || n || ',"hard_flags":["' || strand || '"],"model_id":"' || mid || '","model_role":"' || CASE WHEN source = 'current' THEN 'current' ELSE 'candidate' END || '_model","risk_tags":' || tags || '}', ',' ORDER BY mid) AS models FROM a GROUP BY locus)
SELECT locus AS locus_id, '{"models":[' || models || '],"sets":[' || sets || ']}' AS card FROM s"""


@query(_CARDS)
def p20_public_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical dumps of cards that name no source."""
    return public_cards.public_cards(*_sets(spark, sf_dir)).select("locus_id", "card")
