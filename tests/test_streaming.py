"""Streams end with what the batch steps give."""

from pyspark.sql import functions as F

from locuskit.operators.evidence import merged_junctions
from locuskit.streaming import junctions as stream


def test_running_junctions(spark, tmp_path):
    schema = "seqid string, start long, `end` long, strand string, sample string, reads long, hang long"
    for i in range(3):
        spark.createDataFrame([("c", 1, 9, "+", f"s{i}", 2 + i, 5 * i), ("c", 20, 30, "-", "s0", 1, 1)], schema).write.parquet(str(tmp_path / "in"), mode="append")
    batch = spark.read.parquet(str(tmp_path / "in"))
    q = stream.running_junctions(stream.arriving(spark, str(tmp_path / "in"), batch.schema, 1)).writeStream.outputMode("complete").format("memory").queryName("junctions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    columns = ["seqid", "start", "end", "strand", "reads", "hang", "samples"]
    assert {tuple(r) for r in spark.table("junctions").select(columns).collect()} == {tuple(r) for r in merged_junctions(batch).select(columns).collect()}


def test_decisions_are_written_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("cards", "sink", "check"))
    decide = lambda df: df.select("card_id", F.lit("select_annotation_set").alias("decision"))
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "card_id long").coalesce(1).write.parquet(source, mode="append")
        stream.decided(stream.arriving(spark, source, spark.read.parquet(source).schema), decide, sink, checkpoint).awaitTermination(120)
    assert sorted(r.card_id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windowed_counts(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.write.parquet(str(tmp_path / "e"))
    q = stream.windowed_counts(stream.arriving(spark, str(tmp_path / "e"), df.schema), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == df.count()


def test_running_totals_go_on_after_a_restart(spark, tmp_path):
    """New files after a stream has ended change only their own keys; a batch holds what it changed."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "seqid string, start long, `end` long, strand string, sample string, reads long, hang long"
    for rows in ([("c", 1, 9, "+", "a", 2, 5), ("c", 20, 30, "-", "a", 1, 1)], [("c", 1, 9, "+", "b", 3, 7)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source, mode="append")
        totals = stream.running_junctions(stream.arriving(spark, source, spark.read.parquet(source).schema, 1))
        stream.accumulated(totals, out, check).awaitTermination(120)
    assert [r.reads for r in spark.read.parquet(f"{out}/batch=1").collect()] == [5]
    got = {r.start: (r.reads, r.hang, r.samples) for r in stream.latest(spark, out, totals.schema, ["seqid", "start", "end", "strand"]).collect()}
    assert got == {1: (5, 7, 2), 20: (1, 1, 1)}


def test_sessions_merge_across_batches(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for times in (["2024-01-01 00:00:00", "2024-01-01 00:50:00"], ["2024-01-01 00:25:00", "2024-01-01 03:00:00"]):
        spark.createDataFrame([(1, t) for t in times], "u long, t string").coalesce(1).write.parquet(source, mode="append")
        found = stream.sessions(stream.arriving(spark, source, spark.read.parquet(source).schema, 1), "t", "u", "30 minutes")
        stream.accumulated(found, out, check, "complete").awaitTermination(120)
    assert sorted((str(r.start), str(r.last), r.n) for r in stream.latest_whole(spark, out, found.schema).collect()) == [("2024-01-01 00:00:00", "2024-01-01 00:50:00", 3), ("2024-01-01 03:00:00", "2024-01-01 03:00:00", 1)]
