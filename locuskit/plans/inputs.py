"""Readers and writers of evidence, over lines and tables made of the given ones: junction files, manifests, folders, JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.plans.registry import query
from locuskit.plans.views import observed, table
from locuskit.session import shared_dir
from locuskit.sources import evidence_tables, readers, writers


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an aligner's file and of a table with a header, which hold odd and even lines of the orders."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"))
    at = (F.col("l_orderkey") * 100 + F.col("l_linenumber") + 1).alias("row_idx")
    cell = lambda *c: F.concat_ws("\t", *[x.cast("string") for x in c])
    chrom, end = F.concat(F.lit("chr"), (F.col("s") % 5).cast("string")), F.col("p") + 100 + F.col("s")
    bare = x.filter("l_linenumber % 2 = 1").select(at, cell(chrom, F.col("p"), end, F.col("s") % 4, F.col("p") % 8, F.lit(0), F.col("q"), F.col("s") % 3, F.col("q") + 5).alias("line"))
    named = x.filter("l_linenumber % 2 = 0").select(at, cell(F.col("q"), F.when(F.col("s") % 7 > 0, "+").otherwise(""), F.concat(end.cast("string"), F.lit(".0")), F.col("p"), chrom).alias("line"))
    head = spark.createDataFrame([(0, "junction_read_count\tstrand\tintron_end_1based\tintron_start_1based\tchrom")], "row_idx long, line string")
    return bare, head.union(named)


@query("""WITH x AS (SELECT l_linenumber % 2 AS odd, 'chr' || (l_suppkey % 5) AS seqid, l_partkey AS start, l_partkey + 100 + l_suppkey AS "end", l_suppkey AS s, l_partkey AS p, l_quantity::BIGINT AS q FROM lineitem)
SELECT seqid, start, "end", CASE WHEN odd = 1 THEN coalesce(['.', '+', '-'][s % 4 + 1], '.') WHEN s % 7 > 0 THEN '+' ELSE '.' END AS strand, CASE WHEN odd = 0 THEN '' ELSE coalesce(['non-canonical', 'GT/AG', 'CT/AC', 'GC/AG', 'CT/GC', 'AT/AC', 'GT/AT'][p % 8 + 1], '.') END AS motif,
  CASE odd WHEN 1 THEN 'aligner' ELSE 'table' END AS sample, CASE odd WHEN 1 THEN q + s % 3 ELSE q END AS reads, CASE odd WHEN 1 THEN q + 5 ELSE 0 END AS hang FROM x""", views=False)
def s11_junction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junction files of two kinds, told apart by their first line: codes are spelt out, columns are met by name."""
    bare, named = _lines(spark, sf_dir)
    both = evidence_tables.junction_file(bare, F.lit("aligner")).union(evidence_tables.junction_file(named, F.lit("table")))
    return both.select("seqid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "motif", "sample", F.col("reads").cast("long").alias("reads"), F.col("hang").cast("long").alias("hang"))


@query("""SELECT seqid, s AS start, e AS "end", strand, sum(reads)::BIGINT AS reads, count(DISTINCT sample) AS samples, string_agg(DISTINCT sample, ',' ORDER BY sample) AS names FROM observed
  JOIN (SELECT seqid, s, e, strand, sample IN ('s1', 's2', 's3') AS part FROM observed GROUP BY ALL HAVING sum(reads) >= 20) k USING (seqid, s, e, strand) WHERE (sample IN ('s1', 's2', 's3')) = part GROUP BY ALL""")
def s12_junction_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junction tables of two runs: rows below the thresholds go, then reads add up and samples unite."""
    o = observed(spark, sf_dir).withColumn("run", F.col("sample").isin("s1", "s2", "s3"))
    tables = o.groupBy("run", "seqid", "start", "end", "strand").agg(F.sum("reads").alias("reads"), F.array_sort(F.collect_set("sample")).alias("names"))
    text = tables.select(
        F.col("seqid").alias("chrom"), F.col("start").cast("string").alias("intron_start_1based"), F.col("end").cast("string").alias("intron_end_1based"), F.when(F.col("strand") == ".", "").otherwise(F.col("strand")).alias("strand"),
        F.col("reads").cast("string").alias("junction_read_count"), F.size("names").cast("string").alias("sample_support_count"), F.array_join("names", ",").alias("supporting_samples"),
    )
    got = evidence_tables.junction_tables(text, 20, 1)
    return got.select("seqid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", F.col("reads").cast("long").alias("reads"), F.col("samples").cast("long").alias("samples"), F.array_join("names", ",").alias("names"))


@query("SELECT sample, count(*) AS n FROM observed WHERE sample IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 > 0) GROUP BY sample")
def s14_sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the samples that a manifest names."""
    manifest = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).otherwise("").alias("sample_id"))
    wanted = evidence_tables.sample_ids(manifest).withColumnRenamed("sample_id", "sample")
    return observed(spark, sf_dir).join(wanted, "sample", "left_semi").groupBy("sample").agg(F.count("*").alias("n"))


_LONG = """WITH o AS (SELECT *, ['flA', 'flB', 'flC'][1 + o_orderkey % 3] AS own FROM orders)
SELECT own AS source, 't' || o_custkey AS transcript, max_by(o_orderpriority, o_orderkey) AS support, max_by(o_orderkey % 4, o_orderkey)::BIGINT AS conflicts, max_by(CASE o_orderkey % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c' ELSE '' END, o_orderkey) AS risks FROM o GROUP BY own, o_custkey"""


@query(_LONG, views=False)
def s18_long_read_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a folder for each source, written and read back: of repeated keys the last row counts, and the columns of a source
    may stand in another order (S18, S07, K01, K13)."""
    base = _place(spark, "long-reads")
    o = table(spark, sf_dir, "orders").select(
        F.element_at(F.array(*map(F.lit, ("flA", "flB", "flC"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("own"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("model_id"), F.col("o_orderpriority").alias("support_class"), (F.col("o_orderkey") % 4).alias("conflicting_chain_count"),
        F.when(F.col("o_orderkey") % 5 == 0, "a,b").when(F.col("o_orderkey") % 5 == 1, "c").otherwise("").alias("risk_tags"), "o_orderkey",
    )
    columns = ["model_id", "support_class", "conflicting_chain_count", "risk_tags"]
    genes = o.select("own", F.col("model_id").alias("locus_id"), F.lit("exact").alias("support_level")).distinct()
    for own in ("flA", "flB", "flC"):
        # Rows of one key stand in order in one part.
        rows = o.filter(F.col("own") == own).repartition("model_id").sortWithinPartitions("o_orderkey")
        writers.write_table(rows, f"{base}/{own}/{evidence_tables.BY_MODEL}", columns if own < "flC" else columns[::-1])
        writers.write_table(genes.filter(F.col("own") == own), f"{base}/{own}/{evidence_tables.BY_SET}", ["locus_id", "support_level"])
    models, _ = evidence_tables.long_read_tables(spark, base)
    return models.select("source", "transcript", "support", "conflicts", F.array_join("risks", ",").alias("risks"))


@query("SELECT k AS key, max_by(event_type, event_id) AS validation_status, max(event_id) AS row_idx FROM (SELECT event_id, event_type, CASE WHEN event_id % 4 > 0 THEN 'm' || user_id ELSE 'o' || (user_id % 50) END AS k FROM events) WHERE substr(k, 2)::BIGINT % 2 = 0 GROUP BY k", views=False)
def s19_model_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation table by the first of its key columns that isn't empty, its last row, for wanted models."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_idx"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("m"), F.col("user_id").cast("string"))).otherwise("").alias("model_id"),
        F.concat(F.lit("o"), (F.col("user_id") % 50).cast("string")).alias("object_id"), F.col("event_type").alias("validation_status"),
    )
    wanted = e.select(F.explode(F.array("model_id", "object_id")).alias("key")).filter("try_cast(substr(key, 2) AS long) % 2 = 0").distinct()
    return evidence_tables.summary_by_model(e).join(wanted, "key", "left_semi").select("key", "validation_status", "row_idx")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey % 4 <> 1", views=False)
def s25_included_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a manifest that are to be included: flags that are true in any spelling, or absent."""
    k = F.col("s_nationkey") % 4
    m = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(k == 0, " Yes ").when(k == 1, "no").when(k == 2, "TRUE").alias("include"))
    return evidence_tables.included(m).select("s_suppkey", "s_nationkey")


@query("SELECT 'chr' || s_suppkey AS seqid, s_nationkey % 5 IN (1, 2) AS organelle FROM supplier", views=False)
def s29_organelles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that a region row marks as of an organelle, wherever that row stands."""
    k = F.col("s_nationkey") % 5
    of = F.when(k == 0, "ID=r").when(k == 1, "ID=r;genome=Chloroplast").when(k == 4, "ID=r;genome=chromosome").otherwise("genome=mitochondrion;ID=r")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("seqid"), F.when(k == 3, "gene").otherwise("Region").alias("feature"), of.alias("attributes"))
    marked = evidence_tables.organelles(rows).withColumn("organelle", F.lit(True))
    return rows.select("seqid").distinct().join(marked, "seqid", "left").select("seqid", F.coalesce("organelle", F.lit(False)).alias("organelle"))


@query("SELECT user_id, max_by(event_type, event_id) AS kind, count(*) AS records FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 9) GROUP BY user_id", views=False)
def s10_records_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with sorted keys, appended twice, and read back for wanted keys alone."""
    path = _place(spark, "records")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    for k in (0, 1):
        writers.write_json_lines(e.filter(F.col("event_id") % 2 == k), path, append=True)
    wanted = table(spark, sf_dir, "customer").filter("c_nationkey < 9").select(F.col("c_custkey").alias("user_id"))
    got = readers.records_of(spark, path, "user_id long, event_id long, event_type string", wanted, "user_id")
    return got.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.count("*").alias("records"))


@query("SELECT event_id::VARCHAR AS id, coalesce(nullif(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN props ELSE NULL END, ''), event_type) AS name FROM events", views=False)
def s07_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed table with quotes, empty cells and nulls, written and read back; an alias is the first cell that isn't empty
    (S07, K01, K11)."""
    path, k = _place(spark, "table"), F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "").when(k == 1, F.col("props")).alias("props"), "event_type")
    writers.write_table(e, path, ["event_id", "props", "event_type", "absent"], compressed=True)
    return readers.table(spark, path, {"id": ("event_id",), "name": ("absent", "props", "event_type")}).select("id", "name")
