"""The domain projected on the given tables, as DataFrames and as the same views in SQL.

Four consecutive order keys share a window of 1,000 positions, one for each source; lines are exons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals

SOURCES = ("current", "ToolA", "ToolB", "ToolC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, seqid, source, strand, gene_id, exon_no, start, end, part, sample, reads."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.row_number().over(order).alias("rn"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    window = F.floor(F.col("l_orderkey") / 4)
    start = (window * 1000 + F.col("rn") * 60 + F.col("l_partkey") % 5).cast("long")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("tx_id"),
        F.concat(F.lit("chr"), (window % 5).cast("string")).alias("seqid"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("source"),
        F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(".").alias("strand"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene_id"),
        F.col("rn").alias("exon_no"), start.alias("start"), (start + F.col("l_quantity").cast("long") - 1).alias("end"),
        F.col("l_suppkey").alias("part"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample"), F.col("l_quantity").cast("long").alias("reads"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transcript with its sorted blocks: tx_id, seqid, source, strand, gene_id, start, end, blocks, gaps, coding.

    Coding blocks are the first four exons without their last position, where something is left.
    """
    keys = ["tx_id", "seqid", "source", "strand", "gene_id"]
    block = F.struct(F.col("start"), F.col("end"))
    grouped = exons(spark, sf_dir).groupBy(*keys).agg(
        F.min("start").alias("tx_start"), F.max("end").alias("tx_end"), F.array_sort(F.collect_list(block)).alias("blocks"),
        F.array_sort(F.collect_list(F.when((F.col("exon_no") <= 4) & (F.col("end") > F.col("start")), F.struct(F.col("start"), (F.col("end") - 1).alias("end"))))).alias("coding"),
    )
    return grouped.select(*keys, F.col("tx_start").alias("start"), F.col("tx_end").alias("end"), "blocks", intervals.proper_introns(F.col("blocks")).alias("gaps"), "coding")


def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, seqid, source, strand, gene_id, start, end: one row per intron."""
    return transcripts(spark, sf_dir).select("tx_id", "seqid", "source", "strand", "gene_id", F.explode("gaps").alias("g")).select("tx_id", "seqid", "source", "strand", "gene_id", "g.*")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junction observations by sample: seqid, start, end, strand, sample, reads, hang."""
    lines = exons(spark, sf_dir)
    before = F.lag("end").over(W.partitionBy("tx_id").orderBy("start", "end"))
    gaps = lines.withColumn("from", before + 1).filter("`from` < start - 1 and part % 3 = 0")
    return gaps.select("seqid", F.col("from").alias("start"), (F.col("start") - 1).alias("end"), "strand", "sample", "reads", (F.col("reads") % 40 + 5).alias("hang"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein hits: hit_id, seqid, start, end, strand."""
    e = table(spark, sf_dir, "events")
    start = (F.col("event_id") * 375 + 1).cast("long")
    return e.select(
        F.col("event_id").alias("hit_id"), F.concat(F.lit("chr"), (F.floor(start / 1000) % 5).cast("string")).alias("seqid"), start.alias("start"),
        (start + 199 + F.col("user_id") % 300).cast("long").alias("end"), F.when(F.col("event_type") == "click", "+").when(F.col("event_type") == "view", "-").otherwise(".").alias("strand"),
    )


SQL = """
WITH exon AS MATERIALIZED (
  SELECT l_orderkey AS tx_id, 'chr' || ((l_orderkey // 4) % 5) AS seqid,
         CASE l_orderkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'ToolA' WHEN 2 THEN 'ToolB' ELSE 'ToolC' END AS source,
         CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand, 'g' || o_custkey AS gene_id, rn AS exon_no,
         (l_orderkey // 4) * 1000 + rn * 60 + l_partkey % 5 AS s, (l_orderkey // 4) * 1000 + rn * 60 + l_partkey % 5 + CAST(l_quantity AS BIGINT) - 1 AS e,
         l_suppkey AS part, 's' || l_linenumber AS sample, CAST(l_quantity AS BIGINT) AS reads
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey),
tx AS MATERIALIZED (SELECT tx_id, seqid, source, strand, gene_id, min(s) AS s, max(e) AS e, count(*) AS n FROM exon GROUP BY ALL),
pair AS MATERIALIZED (SELECT *, lag(e) OVER (PARTITION BY tx_id ORDER BY s, e) + 1 AS gs, s - 1 AS ge FROM exon),
intron AS MATERIALIZED (SELECT tx_id, seqid, source, strand, gene_id, gs AS s, ge AS e FROM pair WHERE gs < ge),
cds AS MATERIALIZED (SELECT tx_id, seqid, source, strand, gene_id, s, e - 1 AS e FROM exon WHERE exon_no <= 4 AND e > s),
observed AS (SELECT seqid, gs AS s, ge AS e, strand, sample, reads, reads % 40 + 5 AS hang FROM pair WHERE gs < ge AND part % 3 = 0),
junction AS MATERIALIZED (SELECT seqid, s, e, strand, sum(reads)::BIGINT AS reads, max(hang) AS hang, count(DISTINCT sample) AS samples, string_agg(DISTINCT sample, ',' ORDER BY sample) AS names FROM observed GROUP BY ALL),
hit AS MATERIALIZED (SELECT event_id AS hit_id, 'chr' || (((event_id * 375 + 1) // 1000) % 5) AS seqid, event_id * 375 + 1 AS s, event_id * 375 + 200 + user_id % 300 AS e,
               CASE event_type WHEN 'click' THEN '+' WHEN 'view' THEN '-' ELSE '.' END AS strand FROM events),
"""
