"""Streams over the given tables: running junctions, windows and sessions, and a log of decisions that is taken up again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.plans.registry import query
from locuskit.plans.views import table
from locuskit.session import shared_dir, written
from locuskit.streaming import junctions as stream


def _arriving(df: DataFrame, files: int, label: str) -> DataFrame:
    """The rows of a table as files that arrive one after the other, several batches of a stream."""
    folder, path = written(df.repartition(files), label)
    return stream.arriving(df.sparkSession, path, folder.schema, 1)


def _folders(spark: SparkSession, label: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@query("""SELECT 'chr' || (l_suppkey % 5) AS seqid, l_partkey AS start, l_partkey + 100 + l_suppkey % 7 AS "end", CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE '.' END AS strand, sum(l_quantity)::BIGINT AS reads, max(l_quantity % 40 + 5)::BIGINT AS hang, count(DISTINCT l_linenumber) AS samples FROM lineitem GROUP BY ALL""", views=False)
def t03_running_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions of samples that arrive in several batches, added up as they come; the state after the last."""
    n = F.col("l_quantity").cast("long")
    seen = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("seqid"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 100 + F.col("l_suppkey") % 7).alias("end"), F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise(".").alias("strand"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample"), n.alias("reads"), (n % 40 + 5).alias("hang"),
    )
    totals = stream.running_junctions(_arriving(seen, 3, "observed"))
    out, checkpoint = _folders(spark, "running-junctions")
    stream.accumulated(totals, out, checkpoint).awaitTermination()
    return stream.latest(spark, out, totals.schema, ["seqid", "start", "end", "strand"])


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""", views=False)
def t04_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users' events that arrive out of order in several batches (T04, an extension: the batch steps know no time)."""
    totals = stream.sessions(_arriving(table(spark, sf_dir, "events").select("user_id", "ts"), 2, "events"), "ts", "user_id", "1 hour", "3650 days")
    out, checkpoint = _folders(spark, "sessions")
    stream.accumulated(totals, out, checkpoint, "complete").awaitTermination()
    return stream.latest_whole(spark, out, totals.schema)


@query("""SELECT t + INTERVAL (6 * k) HOUR AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP, TIMESTAMP '1970-01-01') - INTERVAL 18 HOUR AS t, event_type FROM events), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""", views=False)
def t04_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of a day that slide by six hours, counted as they arrive (T04, an extension)."""
    totals = stream.windowed_counts(_arriving(table(spark, sf_dir, "events").select("event_type", "ts"), 3, "events"), "ts", "event_type", "1 day", "3650 days", "6 hours")
    out, checkpoint = _folders(spark, "sliding")
    stream.accumulated(totals, out, checkpoint).awaitTermination()
    return stream.latest(spark, out, totals.schema, ["start", "event_type"])


@query("SELECT DISTINCT user_id AS card_id, CASE WHEN user_id % 3 = 0 THEN 'risk_flagged' ELSE 'select_annotation_set' END AS decision, user_id % 5 = 0 AS repeated, 1::BIGINT AS valid FROM events", views=False)
def t01_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that arrive again and again, decided once each; a second run over all of them decides those again whose decision was
    not valid, and no others (T01, T02, K03)."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("card_id"), "event_id")
    log, first = _folders(spark, "decisions")
    made = F.when(F.col("card_id") % 3 == 0, "risk_flagged").otherwise("select_annotation_set")

    def decide(failing: bool):
        broken = F.lit(failing) & (F.col("card_id") % 5 == 0)
        return lambda cards: cards.select("card_id", F.when(broken, "").otherwise(made).alias("decision"))

    for failing, at in ((True, first), (False, f"{first}-again")):
        stream.decided(_arriving(events, 2, "cards"), decide(failing), log, at, buckets=16, valid="decision <> ''").awaitTermination()
    records = spark.read.parquet(log).select("card_id", "decision", "batch", (F.col("decision") == "").alias("empty"))
    counts = records.groupBy("card_id").agg(F.bool_or("empty").alias("repeated"), F.count_if(~F.col("empty")).alias("valid"))
    best = stream.best_records(records.withColumn("at", F.struct(~F.col("empty"), "batch")), "card_id", F.col("decision") != "", "at")
    return best.select("card_id", "decision").join(counts, "card_id")
