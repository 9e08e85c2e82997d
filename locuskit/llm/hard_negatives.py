"""Hard negatives by norm-bucketed search.

Candidates are sorted by norm and cut into parts, which go to tasks, and within a task into buckets. A row's inner product
with an anchor is at most the product of the norms (Cauchy-Schwarz), so a part or bucket whose largest norm can't reach what
an anchor still needs is left out: the lower limit of its score window, or the kth best score found so far. Parts are
worked off in waves of falling norm; each wave starts with the kth scores of those before it. Anchors stream past the part
that a task holds, so memory is bounded by a part and a block of anchors; many anchors are dealt over several such tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from locuskit.llm.shared import discard, small, stash_at, table

#: Rows of a bucket, least and most rows of a part, anchors that pass one copy of a part, anchors compared at a time.
BUCKET, PART, STREAM, BLOCK = 512, (2_048, 65_536), 262_144, 256
#: Parts of the first wave, of which each further one has more by this factor.
WAVE = 32
#: Scores are exact as doubles below this.
EXACT = 2.0**53
#: Added to bounds, for the rounding of norms.
SLACK = 1 + 1e-9
_FOUND = "r long, w long, score long, id long"


def part_rows(rows: int) -> int:
    """Rows of a part: with the root of the table, so that parts and the anchors copied to them grow alike, within PART."""
    return min(PART[1], max(PART[0], 16 * math.isqrt(rows)))


def _matrix(lists, width: int):
    """Rows of a list array as a matrix, ended with zeros where shorter."""
    import numpy as np

    sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), dtype="f8")
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _best(group, score, ident, k: int):
    """The first k of each group, by falling score, then id; as indices in that order."""
    import numpy as np

    order = np.lexsort((ident, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < k]


def _search(batches: Iterator, same: bool, k: int) -> Iterator:
    """The k best rows in each window of each anchor, from rows sorted by (part, copy, kind, falling norm).

    Rows of kind 0 are the candidates of a part, those of kind 1 the anchors that pass it. `same`: rows of the anchor's
    label without the anchor's own id; else rows of other labels.
    """
    import numpy as np
    import pyarrow as pa

    codes: dict[str, int] = {}
    coded = lambda col: np.array([codes.setdefault(x, len(codes)) for x in col.to_pylist()], dtype=np.int64)

    def compared(held: dict, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        windows = rows.column("windows")
        per = np.asarray(windows.value_lengths())
        flat = windows.flatten()
        w, low, high, need = (np.asarray(flat.field(i)) for i in range(4))
        owner = np.repeat(np.arange(rows.num_rows), per)
        own_id, own_label, norm = rows.column("id").to_numpy(), coded(rows.column("label")), np.sqrt(rows.column("n2").to_numpy())
        width = max(held["width"], int(np.asarray(rows.column("vec").value_lengths()).max(initial=0)))
        vectors = _matrix(rows.column("vec"), width)
        need = np.maximum(low, need)
        group, score, ident = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for at in range(0, len(held["ids"]), BUCKET):
            reach = norm * held["norm"][at] * SLACK  # norms fall, so the first is the largest
            alive = np.flatnonzero(need <= reach[owner])
            if not len(alive):
                break
            mine, where = np.unique(owner[alive], return_inverse=True)
            ids, labels, bucket = held["ids"][at : at + BUCKET], held["labels"][at : at + BUCKET], held["vectors"][at : at + BUCKET]
            scores = vectors[mine][:, : bucket.shape[1]] @ bucket.T
            allowed = labels == own_label[mine][:, None]
            allowed = allowed & (ids != own_id[mine][:, None]) if same else ~allowed
            scores = np.where(allowed, scores, -np.inf)[where]
            scores[(scores > high[alive][:, None]) | (scores < need[alive][:, None])] = -np.inf
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(alive), -np.inf)
            hit, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            if not len(hit):
                continue
            group, score, ident = np.r_[group, alive[hit]], np.r_[score, scores[hit, col]], np.r_[ident, ids[col]]
            kept = _best(group, score, ident, k)
            group, score, ident = group[kept], score[kept], ident[kept]
            full, count = np.unique(group, return_counts=True)
            ends = np.cumsum(count) - 1
            full, ends = full[count == k], ends[count == k]
            need[full] = np.maximum(need[full], score[ends])  # a later row of that score may still have a smaller id
        if not len(group):
            return None
        r = rows.column("r").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(r[owner[group]]), pa.array(w[group]), pa.array(score.astype("i8")), pa.array(ident)], names=["r", "w", "score", "id"])

    key, waiting, held = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, part, copy = (batch.column(c).to_numpy() for c in ("kind", "part", "copy"))
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if (now := (part[i], copy[i])) != key:
                key, waiting, held = now, [], None
            if kind[i] == 0:
                waiting.append(batch.slice(i, j - i))
                continue
            if held is None and waiting:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                one = lambda c, rows=rows: rows.column(c).combine_chunks()
                vec = one("vec")
                width = int(np.asarray(vec.value_lengths()).max(initial=0))
                held = {"ids": one("id").to_numpy(), "labels": coded(one("label")), "norm": np.sqrt(one("n2").to_numpy()), "vectors": _matrix(vec, width), "width": width}
                waiting = []
            for a in range(i, j, BLOCK) if held else ():
                if (out := compared(held, batch.slice(a, min(BLOCK, j - a)))) is not None:
                    yield out


def _first_in_windows(base: DataFrame, parts: DataFrame, n_parts: int, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> tuple[DataFrame, str]:
    """`r`, `w`, `score`, `id`, `rank`: the first k rows in each window (r, w, low, high) of each anchor r; and their path."""
    spark = base.sparkSession
    copies = max(1, math.ceil(anchors.count() / STREAM))
    kind = lambda n: F.lit(n).alias("kind")
    best = path = None
    begin, size = 0, 1
    window_type = "array<struct<w:bigint,low:double,high:double,need:double>>"
    while begin < n_parts:
        end = min(n_parts, begin + size)
        kth = windows.withColumn("need", F.col("low")) if best is None else windows.join(best.filter(F.col("rank") == k).select("r", "w", F.col("score").cast("double").alias("need")), ["r", "w"], "left")
        asked = kth.groupBy("r").agg(F.collect_list(F.struct("w", "low", "high", F.coalesce("need", "low").alias("need"))).alias("windows"))
        passing = (
            anchors.join(asked, "r").withColumn("part", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).join(small(parts), "part")
            .withColumn("reach", F.sqrt("n2") * F.sqrt("top") * SLACK).withColumn("windows", F.filter("windows", lambda x: F.greatest(x["low"], x["need"]) <= F.col("reach"))).filter(F.size("windows") > 0)
            .select("part", F.pmod(F.xxhash64("r"), F.lit(copies)).cast("int").alias("copy"), kind(1), "r", "id", "label", "n2", "vec", F.col("windows").cast(window_type).alias("windows"))
        )
        held = base.filter((F.col("part") >= begin) & (F.col("part") < end)).select("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), kind(0), F.lit(None).cast("long").alias("r"), "id", "label", "n2", "vec", F.lit(None).cast(window_type).alias("windows"))
        met = held.union(passing).repartition("part", "copy").sortWithinPartitions("part", "copy", "kind", F.desc("n2"))
        found = met.mapInArrow(lambda b: _search(b, same, k), _FOUND)
        if best is not None:
            found = found.union(best.select("r", "w", "score", "id"))
        order = W.Window.partitionBy("r", "w").orderBy(F.desc("score"), "id")
        ranked, next_path = stash_at(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "negatives")
        if path:
            discard(spark, path)
        best, path, begin, size = ranked, next_path, end, size * WAVE
    return best, path


def hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first `negatives` rows of other labels
    whose score lies between `low` and `high` percent of the positive's: `anchor_id`, `positive_id`, `rank`, `negative_id`,
    `positive_score`, `negative_score`.

    `anchors` is a condition on the columns of `df`. Components are floor(scale * x); a score is the inner product, higher
    ones first, ties by smaller id. Rows with a null id, label or vector, or a null or non-finite component take no part. Of
    vectors of different sizes the shorter counts as ended with zeros; an empty or zero vector scores 0 with every row. Rows
    of the anchor's id are no positives of it; apart from that rows that repeat an id are rows of their own. A positive of
    negative score has no negatives, an anchor without positives no rows. An empty table gives an empty result. Norms whose
    square needs more than 53 bits raise an error, as scores would no longer be exact.
    """
    spark = df.sparkSession
    fits = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(fits, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"),
    )
    rows = rows.withColumn("n2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dealt = rows.repartitionByRange(math.ceil(n / part_rows(n)), F.desc("n2"), "id").withColumns({"part": F.spark_partition_id(), "r": F.monotonically_increasing_id()})
    base, base_path = stash_at(dealt, "vectors")
    parts, parts_path = stash_at(base.groupBy("part").agg(F.max("n2").alias("top")), "parts")
    n_parts, top = parts.agg(F.max("part") + 1, F.max("top")).first()
    if top >= EXACT:
        raise ValueError("scores of these vectors need more than 53 bits")
    asking = base.filter("anchor").select("r", "id", "label", "n2", "vec")

    everything = asking.select("r", F.lit(0).cast("long").alias("w"), F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"))
    near, near_path = _first_in_windows(base, parts, n_parts, asking, everything, True, positives)
    limits = near.filter("score >= 0").select("r", F.col("score").alias("w")).distinct()
    share = lambda percent, up: F.expr(f"cast((w * {int(percent)} + {up}) div 100 as double)")
    windows, windows_path = stash_at(limits.select("r", "w", share(low, 99).alias("low"), share(high, 0).alias("high")).filter("low <= high"), "windows")
    far, far_path = _first_in_windows(base, parts, n_parts, asking, windows, False, negatives)
    result, _ = stash_at(
        near.select("r", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(far.select("r", F.col("w").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["r", "positive_score"])
        .join(asking.select("r", F.col("id").alias("anchor_id")), "r")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
        "mined",
    )
    for done in (base_path, parts_path, near_path, windows_path, far_path):
        discard(spark, done)
    return result


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 3
"""
