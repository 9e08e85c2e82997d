"""Junctions and decisions as they arrive: the batch steps as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from locuskit.operators.evidence import JUNCTION


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_junctions(observed: DataFrame) -> DataFrame:
    """Reads, overhang and the exact number of samples per junction so far, for update or complete mode. The state of a
    junction holds the names of its samples, since thresholds of support count them."""
    return observed.groupBy(*JUNCTION).agg(F.sum("reads").alias("reads"), F.max("hang").alias("hang"), F.size(F.collect_set("sample")).cast("long").alias("samples"))


def windowed_counts(events: DataFrame, time: str, by: str, length: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts per window, which tumbles, or slides by `slide`; rows later than the watermark are left out (an extension: the
    batch steps know no time)."""
    at = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return at.groupBy(F.window("__t", length, slide), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Runs of a key's events with less than `gap` between neighbours: by, start, the last event's time and their number (an
    extension). For complete or append mode; Spark doesn't update sessions that merge."""
    at = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return at.groupBy(F.session_window("__t", gap), by).agg(F.count("*").alias("n"), F.max("__t").alias("last")).select(by, F.col("session_window.start").alias("start"), "last", "n")


def accumulated(totals: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """A running aggregation as a folder of batches (`batch=0` and on): in update mode each holds the keys that it changed, in
    complete mode the whole result. A batch that is run again after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return totals.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """The present state of what `accumulated` wrote in update mode: of each key the row of its last batch."""
    held = spark.read.schema(StructType(schema.fields).add("batch", "long")).parquet(path)
    return held.groupBy(*key).agg(F.max_by(F.struct(*[c for c in schema.names if c not in key]), "batch").alias("__r")).select(*key, "__r.*")


def latest_whole(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The last batch of what `accumulated` wrote in complete mode. The number of batches is read from the folder's names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    last = max(int(f.getPath().getName().split("=")[1]) for f in found if f.getPath().getName().startswith("batch="))
    return spark.read.schema(schema).parquet(f"{path}/batch={last}")


#: Partitions of a log by hash of the key.
BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def logged(spark: SparkSession, path: str, touched: list[int]) -> DataFrame | None:
    """The rows of a log in the partitions touched, or None where there is no log yet: other partitions aren't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path).filter(F.col("bucket").isin(touched))


def best_records(records: DataFrame, key: str, valid: Column, order: str) -> DataFrame:
    """One record for each key: the last valid one, or the last if none is valid."""
    rank = F.struct(F.coalesce(valid, F.lit(False)), F.col(order))
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), rank).alias("r")).select(key, "r.*")


def decided(cards: DataFrame, decide: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "card_id", buckets: int = BUCKETS, valid: str | None = None) -> StreamingQuery:
    """Decisions of cards, appended to a log that is partitioned by hash of the key (`bucket`), with the number of their `batch`.

    A batch leaves out the cards that the log already has, so that a restart, or a card that comes again, changes nothing; with
    `valid`, a condition on decisions, only valid ones count as had, and the others are decided again. It reads the keys of
    those partitions alone that its own cards fall into, which are as many as the batch has cards at most.
    """

    def batch(df: DataFrame, number: int) -> None:
        new = df.dropDuplicates([key]).withColumn("__bucket", bucket_of(F.col(key), buckets))
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most `buckets` numbers
        had = logged(df.sparkSession, path, touched) if touched else None
        if had is not None:
            new = new.join((had.filter(valid) if valid else had).select(key).distinct(), key, "left_anti")
        if touched:
            decide(new.drop("__bucket")).withColumns({"batch": F.lit(number).cast("long"), "bucket": bucket_of(F.col(key), buckets)}).write.mode("append").partitionBy("bucket").parquet(path)

    return cards.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
