"""Exact deduplication by content sort, with DataFrame functions only.

Sampled splitters cut the order (text prefix, text hash, id) into ranges; each range is sorted externally by the whole
normalised text, so equal texts lie side by side and a full comparison of neighbours finds them. The id is part of the
splitter key: a text that makes up a third of the corpus is spread over many ranges, and only the runs that touch a
range border (a few per range) are matched across ranges.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.llm.shared import row_of, small, stash, table

SPACE = r"[\x20\x09-\x0D]+"
#: Characters of the text in a splitter; longer common prefixes are told apart by the text's hash.
PREFIX = 64
#: Ranges per shuffle partition, sampled keys per range, and the most ranges: 16,384 splitters and 200,000 sampled keys are a
#: few tens of MB at any size of the corpus; beyond that the ranges grow, and each is sorted externally.
RANGES, SAMPLES, MOST_RANGES = 8, 12, 1 << 14
#: Place of a null id in the order.
LAST_ID = 2**63 - 1
_KEYS = "array<struct<p:string,h:bigint,d:bigint>>"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _key(norm: Column, ident: Column) -> Column:
    return F.struct(F.left(norm, F.lit(PREFIX)).alias("p"), F.xxhash64(norm).alias("h"), F.coalesce(ident, F.lit(LAST_ID)).alias("d"))


def _splitters(rows: DataFrame, ranges: int) -> list[dict]:
    """At most `ranges` - 1 keys of a random sample of about `ranges` * SAMPLES rows, evenly apart."""
    total = rows.count()
    if not total:
        return []
    share = min(1.0, ranges * SAMPLES / total)
    keys = rows.sample(share, seed=11).select(_key(normalised(F.col("text")), F.col("id")).alias("k")).select("k.*").distinct()
    found = sorted(tuple(r) for r in keys.collect())
    cut = [found[len(found) * i // ranges] for i in range(1, ranges)] if len(found) > ranges else found[1:]
    return [dict(zip("phd", k, strict=True)) for k in cut]


def _range_of(keys: Column, key: Column, n: int) -> Column:
    """Number of splitters at or below the key, by binary search over the constant array; the key is computed once."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n).bit_length()))])
    search = lambda k: F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(keys, lo + step - F.lit(1)) <= k, lo + step).otherwise(lo))
    return F.get(F.transform(F.array(key), search), F.lit(0))


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """The sorted rows with their run of equal texts, and the first range of each run that may span ranges.

    The second table has a few rows per range: its size follows the number of ranges, not of rows.
    """
    spark = df.sparkSession
    # The text crosses the network once: with the row, where rows are asked for.
    rows = df.select(F.col(id_col).cast("long").alias("id"), row_of(df if carry else df.select(text_col)))
    text = F.col("row")[text_col].cast("string")
    ranges = max(2, min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = _splitters(rows.select("id", text.alias("text")), ranges)
    keys = F.from_json(F.lit(json.dumps(found)), _KEYS)

    norm = normalised(text)
    # The sort needs the normalised text, but only the original crosses the network.
    ranged = rows.withColumn("part", _range_of(keys, _key(norm, F.col("id")), len(found))).repartition("part").withColumn("norm", norm)
    order = W.partitionBy("part").orderBy("norm", F.col("id").asc_nulls_last())
    fresh = F.coalesce((F.lag("norm").over(order) != F.col("norm")).cast("int"), F.lit(1))
    splitter = lambda at: F.when(at >= 0, F.get(keys, at))
    same = lambda k: F.coalesce((k["p"] == F.left("norm", F.lit(PREFIX))) & (k["h"] == F.xxhash64("norm")), F.lit(False))
    runs = (
        ranged.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("border", same(splitter(F.col("part"))) | same(splitter(F.col("part") - 1)))
        .select(
            "part", "run", "id", "fresh", "border",
            F.when(F.col("border") & (F.col("fresh") == 1), F.col("norm")).alias("border_text"),
            *(["row"] if carry else [F.sha2("norm", 256).alias("text_sha256")]),
        )
    )
    if not carry:
        run = W.partitionBy("part", "run")
        runs = runs.withColumns({"first_id": F.min("id").over(run), "n": F.count("*").over(run)})
    runs = stash(runs, "exact-runs")
    heads = runs.filter("border and fresh = 1")
    # first_id stays the smallest of its range's run, as rows are sorted; only op1's digest needs n.
    whole = heads.groupBy("border_text").agg(F.min("part").alias("part0"), *([] if carry else [F.min("first_id").alias("all_first"), F.sum("n").alias("all_n")]))
    spans = heads.select("part", "run", "border_text").join(whole, "border_text").drop("border_text")
    return runs, stash(spans, "exact-spans")


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal when identical after normalisation. Of equal texts the smallest id stays (null only if all ids are
    null); of rows that agree in text and id exactly one stays. An empty table gives an empty result.
    """
    runs, spans = _sorted_runs(df, id_col, text_col, carry=False)
    return runs.join(small(spans), ["part", "run"], "left").select(
        "id",
        F.when(F.col("part0").isNull(), F.col("first_id")).otherwise(F.col("all_first")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("fresh") == 1) & (F.col("part") == F.coalesce("part0", "part"))).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that `mark_duplicates` keeps, with all their columns."""
    runs, spans = _sorted_runs(df, id_col, text_col, carry=True)
    kept = runs.filter("fresh = 1").join(small(spans), ["part", "run"], "left")
    return kept.filter(F.col("part") == F.coalesce("part0", "part")).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
