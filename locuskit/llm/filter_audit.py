"""Audit of filters that interact: what each removes at each place of each order in which they can be applied.

Native expressions turn a document into a mask of the filters it fails; a grouping by whole text supplies the smallest
doc_id for the last filter. Documents are then counted by part and mask, 32 cells for each part, and every number of the
report follows from the cells: a filter removes those of its failures that no earlier filter of the order has removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import table, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: Orders of all filters, and in how many of them a filter comes first among k given ones: ORDERS / k.
ORDERS = 120
_COUNTS = ("n", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails; `words` holds its words."""
    n = F.size(words)
    failing = {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(c, _bit(k)).otherwise(0) for k, c in failing.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: `id`, `part`, `mask`, and whether it is `good` and `toxic` by the labels.

    Null texts and parts count as empty. A document fails E if a row of a smaller id has the same text, so a row without
    id never does; nor do rows that agree in text and smallest id. A document without labels is neither good nor toxic;
    one with several labelled rows is what any of them says.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
    # The hash tells apart rows that share an id, no more.
    judged = rows.withColumn("words", words).select("id", "part", own_mask(F.col("text"), F.col("words")).alias("own"), F.xxhash64("text").alias("h"))
    first = rows.groupBy("text").agg(F.min("id").alias("id")).select("id", F.xxhash64("text").alias("h"), F.lit(True).alias("first"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    repeated = F.when(F.col("id").isNotNull() & F.col("first").isNull(), _bit("E")).otherwise(0)
    return judged.join(first.distinct(), ["id", "h"], "left").join(marks, "id", "left").select(
        "id", "part", (F.col("own") + repeated).alias("mask"), (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("t", F.lit(0)) == 1).alias("toxic")
    )


def cells(judged: DataFrame) -> DataFrame:
    """One row per part, its 32 cells as arrays by mask: documents (`n`), `good` and `toxic` ones."""
    counted = judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    at = lambda c, m: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long")
    return counted.groupBy("part").agg(*[F.array(*[at(c, m) for m in range(1 << len(FILTERS))]).alias(c) for c in _COUNTS])


def report(by_part: DataFrame) -> DataFrame:
    """One row per part, order and step, from the cells."""
    from itertools import permutations

    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    rows = by_part.select("part", *_COUNTS, F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    at = {k: F.instr("filter_order", k) for k in FILTERS}
    rows = rows.withColumns({
        "own": sum((F.when(at[k] == F.col("step"), _bit(k)).otherwise(0) for k in FILTERS), F.lit(0)),
        "before": sum((F.when(at[k] < F.col("step"), _bit(k)).otherwise(0) for k in FILTERS), F.lit(0)),
    })

    def total(count: str, holds) -> Column:
        """Sum of a count over the masks for which `holds` (a condition on a mask) is true."""
        picked = F.transform(F.col(count), lambda n, m: F.when(holds(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    earlier = lambda m: m.bitwiseAND(before) != 0
    first = lambda m: fails(m) & ~earlier(m)
    # Of a document's k failing filters each is the first in ORDERS / k of the orders.
    shares = F.transform("n", lambda n, m: F.when(fails(m), n * (F.lit(ORDERS) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report over all documents: 600 rows for each part that has any; none for an empty table."""
    return report(cells(masks(docs, labels, id_col, text_col, part_col)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT w.doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), m AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT p.k || q.k || r.k || s.k || u.k AS filter_order FROM x p, x q, x r, x s, x u
  WHERE p.k NOT IN (q.k, r.k, s.k, u.k) AND q.k NOT IN (r.k, s.k, u.k) AND r.k NOT IN (s.k, u.k) AND s.k <> u.k
), g AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS k, n, good, toxic,
         [a, b, c, d, e] AS failing, list_filter([1, 2, 3, 4, 5], lambda i: [a, b, c, d, e][ascii(substr(filter_order, i, 1)) - 64]) AS places
  FROM m, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), h AS (
  SELECT part, filter_order, step, k,
         sum(CASE WHEN len(places) = 0 OR places[1] > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN places[1] = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_contains(places, step) AND places[1] < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN places = [step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN places[1] = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN places[1] = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM g GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM h
"""
