"""Joins of closed intervals on a key, by bins whose width follows the interval's length.

Each interval belongs to the level whose bins are about as long as itself, so it covers a few bins however long it is. A pair
meets at the higher of its two levels: intervals of one level meet there, and a shorter one is listed too at those higher
levels that the other side really has. Only the bin in which both have their first shared position yields the pair, so
nothing is found twice, and no bin ever holds two crowds of short intervals at a coarse level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.session import shared_dir

#: Width of the smallest bins, and the factor from level to level. The last level's bins are 2^10 * 8^7, over any sequence.
LEAST, FACTOR, LEVELS = 1024, 8, 8


def level_of(length: Column) -> Column:
    at = F.lit(0)
    for k in range(1, LEVELS):
        at = F.when(length > LEAST * FACTOR ** (k - 1), F.lit(k)).otherwise(at)
    return at


def _width(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(LEAST * FACTOR**k).cast("long") for k in range(LEVELS)]), level + 1)


def _binned(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each bin of the level given in __level."""
    width = _width(F.col("__level"))
    return df.withColumn("__bin", F.explode(F.sequence((start / width).cast("long"), (end / width).cast("long"))))


def _raised(df: DataFrame, own: str, levels: DataFrame) -> DataFrame:
    """A row for each level above the interval's own that the other side has; there are LEVELS at most."""
    return df.join(F.broadcast(levels), F.col("__level") > F.col(own))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], widen: int = 0) -> DataFrame:
    """Pairs of rows with equal `on` columns whose intervals share a position, or lie at most `widen` apart.

    Both sides need `start` and `end` (start <= end); right columns other than `on` get the suffix `_r`. Rows with a null
    key or bound join nothing.
    """
    r = right.select(*on, *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in on]).filter("start_r is not null and end_r is not null")
    left = left.filter("start is not null and `end` is not null")
    l0, l1, r0, r1 = F.greatest(F.col("start") - widen, F.lit(0)), F.col("end") + widen, F.col("start_r"), F.col("end_r")
    a, b = left.withColumn("__own_l", level_of(l1 - l0 + 1)), r.withColumn("__own_r", level_of(r1 - r0 + 1))
    levels = lambda df, own: df.select(F.col(own).alias("__level")).distinct()
    own_l, own_r = _binned(a.withColumn("__level", F.col("__own_l")), l0, l1), _binned(b.withColumn("__level", F.col("__own_r")), r0, r1)
    up_l, up_r = _binned(_raised(a, "__own_l", levels(b, "__own_r")), l0, l1), _binned(_raised(b, "__own_r", levels(a, "__own_l")), r0, r1)
    first = F.col("__bin") == (F.greatest(l0, r0) / _width(F.col("__level"))).cast("long")
    columns = [*left.columns, *[c for c in r.columns if c not in on]]
    met = lambda x, y: x.join(y, [*on, "__level", "__bin"]).filter((l0 <= r1) & (r0 <= l1) & first).select(*columns)
    return met(own_l, own_r).union(met(up_l, own_r)).union(met(own_l, up_r))


class IntervalIndex:
    """Intervals listed by bins in a table that is bucketed by the join's keys, to be probed again and again.

    An interval is listed at its own level and, once or twice each, at all higher ones, so that any probe finds it whatever
    its length. A probe is shuffled to the buckets of the index; the index itself is read where it lies, without an exchange.
    """

    def __init__(self, spark: SparkSession, name: str, on: list[str]):
        self.rows, self.on = spark.table(name), on
        self.levels = [r[0] for r in self.rows.filter("not __up").select("__level").distinct().collect()]  # LEVELS at most

    @classmethod
    def build(cls, df: DataFrame, on: list[str], name: str, buckets: int | None = None) -> IntervalIndex:
        """Writes the table `name` under the shared folder. Rows with a null key or bound are left out."""
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        r = df.select(*on, *[F.col(c).alias(f"{c}_r") for c in df.columns if c not in on]).dropna(subset=[*on, "start_r", "end_r"])
        at = lambda up: F.array(*[F.lit(k) for k in range(LEVELS)]) if up else F.array(F.col("__own"))
        leveled = r.withColumn("__own", level_of(F.col("end_r") - F.col("start_r") + 1))
        own = _binned(leveled.withColumn("__level", F.explode(at(False))), F.col("start_r"), F.col("end_r")).withColumn("__up", F.lit(False))
        up = _binned(leveled.withColumn("__level", F.explode(at(True))).filter("__level > __own"), F.col("start_r"), F.col("end_r")).withColumn("__up", F.lit(True))
        keys = [*on, "__level", "__bin"]
        listed = own.unionByName(up).drop("__own").repartition(buckets, *keys)
        listed.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}").saveAsTable(name)
        return cls(spark, name, on)

    def probe(self, left: DataFrame, widen: int = 0) -> DataFrame:
        """As `overlap_join` with the indexed rows on the right; `widen` is the flank within which an interval counts."""
        left = left.filter("start is not null and `end` is not null")
        l0, l1, r0, r1 = F.greatest(F.col("start") - widen, F.lit(0)), F.col("end") + widen, F.col("start_r"), F.col("end_r")
        leveled = left.withColumn("__own", level_of(l1 - l0 + 1))
        own = _binned(leveled.withColumn("__level", F.col("__own")), l0, l1).withColumn("__high", F.lit(False))
        raised = leveled.withColumn("__level", F.explode(F.array(*map(F.lit, self.levels)).cast("array<int>"))).filter("__level > __own")
        up = _binned(raised, l0, l1).withColumn("__high", F.lit(True))
        first = F.col("__bin") == (F.greatest(l0, r0) / _width(F.col("__level"))).cast("long")
        met = own.unionByName(up).join(self.rows, [*self.on, "__level", "__bin"]).filter(~(F.col("__up") & F.col("__high")) & (l0 <= r1) & (r0 <= l1) & first)
        return met.select(*left.columns, *[c for c in self.rows.columns if c not in (*self.on, "__level", "__bin", "__up")])


def self_overlaps(df: DataFrame, on: list[str], key: str, widen: int = 0) -> DataFrame:
    """Each overlapping pair of different rows once, the smaller key left."""
    return overlap_join(df, df, on, widen).filter(F.col(key) < F.col(f"{key}_r"))


def back_one_only(pairs: DataFrame, index: DataFrame, on: list[str], key: str) -> DataFrame:
    """Of pairs (query left, index right), those that a probe finds which looks back one row only from the first index start
    not below the query's start. For comparison with such indexes; a full overlap join is the default everywhere."""
    from locuskit.operators import islands

    place = [*on, F.floor(F.col("start") / islands.BIN)]
    numbered = islands.numbered(index.select(*on, "start", "end", key), [*on, "start", "end", key], "__at", place)
    last = numbered.groupBy(*on, "start").agg(F.max("__at").alias("__last")).withColumn("start", F.col("start") + 1)  # those that start before a place
    asked = islands.as_of(pairs.select(*on, "start").distinct(), last, on, "start", "__last").select(*on, "start", F.col("last_value").alias("__from"))
    ranked = numbered.select(*on, F.col(key).alias(f"{key}_r"), "__at")
    seen = pairs.join(ranked, [*on, f"{key}_r"]).join(asked, [*on, "start"]).filter("__from is null or __at >= __from")
    return seen.select(*pairs.columns)
