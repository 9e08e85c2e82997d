"""A store of exact coding structures and the sources that have them, brought up to date for changed sources only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.session import removed

_ROWS = "locus_id string, cds_signature string, source string, part string"
_DIGESTS = "source string, n bigint, digest decimal(38,0)"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def exact_support(spark: SparkSession, store: str) -> DataFrame:
    """What the store holds: locus_id, cds_signature, source."""
    return _read(spark, f"{store}/support", _ROWS).drop("part")


def refreshed(store: str, models: DataFrame) -> tuple[DataFrame, list[str]]:
    """The store after an update from models (locus_id, source, seqid, strand, cds), and the sources that were computed anew.

    A source is known by its number of models and the sum of their hashes, whatever their order; one that is as before isn't
    computed again, and one that is gone leaves. Models of the current annotation, and those without coding blocks, support
    nothing. A changed source is one partition written over; the digests follow last, so a run that breaks off is repeated.
    """
    spark = models.sparkSession
    m = models.filter("lower(source) <> 'current' and source <> ''").select("locus_id", "source", "seqid", "strand", "cds")
    now = m.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.xxhash64("locus_id", "seqid", "strand", "cds").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"))
    kept = [tuple(r) for r in now.collect()]  # one row a source
    before = {tuple(r) for r in _read(spark, f"{store}/digests", _DIGESTS).collect()}
    changed = sorted(r[0] for r in kept if r not in before)
    rows = m.filter(F.col("source").isin(changed)).select("locus_id", text.coding_signature(F.col("seqid"), F.col("strand"), F.col("cds")).alias("cds_signature"), "source").filter("cds_signature <> ''").distinct().withColumn("part", F.hex(F.encode("source", "UTF-8")))
    if changed:
        for s in {x[0] for x in before} & set(changed):  # what has no coding block any more must not stay
            removed(spark, _partition(spark, store, s))
        rows.repartition("part", F.pmod(F.xxhash64("locus_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{store}/support")
    for s in sorted({x[0] for x in before} - {x[0] for x in kept}):
        removed(spark, _partition(spark, store, s))
    if changed or len(before) != len(kept):
        spark.createDataFrame(kept, _DIGESTS).coalesce(1).write.mode("overwrite").parquet(f"{store}/digests")
    return exact_support(spark, store), changed


def _partition(spark: SparkSession, store: str, source: str) -> str:
    return f"{store}/support/part={source.encode().hex().upper()}"


def cache_rows(support: DataFrame) -> DataFrame:
    """As the cache file has them: locus_id, cds_signature, supporting_sources, support_count."""
    sources = F.array_sort(F.collect_set("source"))
    return support.groupBy("locus_id", "cds_signature").agg(F.array_join(sources, ",").alias("supporting_sources"), F.count_distinct("source").alias("support_count"))
