"""Runs of rows: merged intervals, neighbours, forward fill, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.session import written

#: Width of the bins into which a long key is cut, in units of the ordering column.
BIN = 1 << 20


def _carried(places: DataFrame, on: list[str], at: str, value: str, after: bool, width: int) -> DataFrame:
    """For each bin of `places` (on, at, value) its key, number, and the nearest value of the bins before (or after) it.

    One row per bin is all that meets in a window of a key, however many rows the key has.
    """
    bins = places.groupBy(*on, F.floor(F.col(at) / width).alias("__bin")).agg((F.min_by if after else F.max_by)(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("__value"))
    order = W.partitionBy(*on).orderBy(F.desc("__bin") if after else F.asc("__bin")).rowsBetween(W.unboundedPreceding, -1)
    return bins.withColumn("__value", F.last("__value", ignorenulls=True).over(order)).filter("__value is not null")


def as_of(df: DataFrame, anchors: DataFrame, on: list[str], at: str, value: str, after: bool = False, width: int = BIN) -> DataFrame:
    """Each row with the anchor value at or before (or strictly after) its place, or null; no join of rows with anchors.

    Rows and anchors are sorted within bins of `width` places of a key, so a key with many rows is many tasks' work, and a
    bin starts with what the bins before it hand on. Anchors at one place should be reduced to one.
    """
    name = "next_value" if after else "last_value"
    kind = anchors.schema[value].dataType
    told = anchors.select(*on, at, F.col(value).alias("__value"))
    carried = _carried(told.union(df.select(*on, at, F.lit(None).cast(kind))), on, at, "__value", after, width)
    rows = df.withColumns({"__value": F.lit(None).cast(kind), "__kind": F.lit(1), "__bin": F.floor(F.col(at) / width)})
    both = rows.unionByName(told.withColumns({"__kind": F.lit(0), "__bin": F.floor(F.col(at) / width)}), allowMissingColumns=True).unionByName(carried.withColumn("__kind", F.lit(-1)), allowMissingColumns=True)
    # What is handed on comes first; at one place an anchor counts as before the rows, so a strict look ahead passes it over.
    first = F.when(F.col("__kind") == -1, 0).otherwise(1)
    order = W.partitionBy(*on, "__bin").orderBy(first, F.desc(at), F.desc("__kind")) if after else W.partitionBy(*on, "__bin").orderBy(first, F.asc(at), F.asc("__kind"))
    found = F.last("__value", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn(name, found).filter("__kind = 1").drop("__value", "__kind", "__bin")


def forward_fill(df: DataFrame, on: list[str], order: str, column: str, width: int = BIN) -> DataFrame:
    """The column's last value that isn't null, in the given numeric order; bins as in `as_of`."""
    carried = _carried(df.select(*on, order, column), on, order, column, False, width)
    both = df.withColumns({"__kind": F.lit(1), "__bin": F.floor(F.col(order) / width)}).unionByName(carried.withColumnRenamed("__value", column).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    by = W.partitionBy(*on, "__bin").orderBy("__kind", order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn(column, F.last(column, ignorenulls=True).over(by)).filter("__kind = 1").drop("__kind", "__bin")


def merge_intervals(df: DataFrame, on: list[str], gap: int = 1, width: int = BIN) -> DataFrame:
    """Intervals of a key joined where they overlap or are at most `gap` apart (1: touch): start, end, n.

    Intervals of one start are pre-combined. The largest end so far is a running maximum in bins of `width` starts, and each
    bin begins with that of the bins before it; so is the first start of the island that a bin begins within. Rows with a
    null bound are left out.
    """
    ends = df.filter("start is not null and `end` is not null").groupBy(*on, F.col("start").cast("long").alias("start")).agg(F.max(F.col("end").cast("long")).alias("end"), F.count("*").alias("n"))
    ends, _ = written(ends, "intervals")  # read twice for each of the two values that bins hand on
    binned = ends.withColumns({"__bin": F.floor(F.col("start") / width), "__kind": F.lit(1)})
    bins = binned.groupBy(*on, "__bin").agg(F.max("end").alias("end"))
    carried = bins.withColumn("end", F.max("end").over(W.partitionBy(*on).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1))).filter("`end` is not null").withColumn("__kind", F.lit(0))
    both = binned.unionByName(carried, allowMissingColumns=True)
    reached = F.max("end").over(W.partitionBy(*on, "__bin").orderBy("__kind", "start").rowsBetween(W.unboundedPreceding, -1))
    opened = both.withColumn("__first", F.when(F.coalesce(F.col("start") > reached + gap, F.lit(True)), F.col("start"))).filter("__kind = 1").drop("__kind", "__bin")
    return forward_fill(opened, on, "start", "__first", width).groupBy(*on, "__first").agg(F.max("end").alias("end"), F.sum("n").alias("n")).select(*on, F.col("__first").alias("start"), "end", "n")


def running(df: DataFrame, on: list[str], order: str, sums: dict[str, Column], width: int = BIN) -> DataFrame:
    """`df` with the sum of each expression over the rows of the key before a row (0 for the first), by a numeric order that
    tells rows apart; one row per bin hands on what the bins before it sum up to."""
    names = list(sums)
    binned = df.withColumns({**{f"__{n}": sums[n].cast("long") for n in names}, "__bin": F.floor(F.col(order) / width), "__kind": F.lit(1)})
    before = W.partitionBy(*on).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    carried = binned.groupBy(*on, "__bin").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names]).select(*on, "__bin", *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in names], F.lit(0).alias("__kind"))
    both = binned.unionByName(carried, allowMissingColumns=True)
    by = W.partitionBy(*on, "__bin").orderBy("__kind", order).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumns({n: F.coalesce(F.sum(f"__{n}").over(by), F.lit(0)) for n in names}).filter("__kind = 1").select(*df.columns, *names)


def lagged(df: DataFrame, on: list[str], order: list[str], column: str, name: str, width: int = BIN) -> DataFrame:
    """`df` with the column's value in the row before, or null; the first of the ordering columns is numeric and makes the bins."""
    binned = df.withColumns({"__bin": F.floor(F.col(order[0]) / width), "__kind": F.lit(1)})
    last = binned.groupBy(*on, "__bin").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__v"))
    before = W.partitionBy(*on).orderBy("__bin")
    carried = last.select(*on, "__bin", F.lag("__v").over(before).alias("__v")).filter("__v is not null").select(*on, "__bin", F.col("__v.v").alias(column), F.lit(0).alias("__kind"))
    both = binned.unionByName(carried, allowMissingColumns=True)
    return both.withColumn(name, F.lag(column).over(W.partitionBy(*on, "__bin").orderBy("__kind", *order))).filter("__kind = 1").select(*df.columns, name)


def upper_median(df: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """`on` and the upper median of a column that isn't null: equal values are counted first, the counts are summed in order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("__n"))
    key = W.partitionBy(*on)
    reached = counts.withColumns({"__to": F.sum("__n").over(key.orderBy(value)), "__all": F.sum("__n").over(key)})
    return reached.filter("__to > __all div 2").groupBy(*on).agg(F.min(value).alias(name))


def numeric_steps(df: DataFrame, on: list[str], number: str, name: str = "step") -> DataFrame:
    """`on` and the greatest common divisor of the differences between numbers of a key, at least 1; null numbers don't count.

    That is the divisor of all distances from the least number. It is folded in levels, each over sets of at most FOLD values.
    """
    numbers = df.filter(F.col(number).isNotNull()).select(*on, F.col(number).cast("long").alias("__d")).distinct()
    least = numbers.groupBy(*[F.col(c).alias(f"__key_{c}") for c in on]).agg(F.min("__d").alias("__low"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    at = numbers.join(least, same).select(*on, (F.col("__d") - F.col("__low")).alias("__d")).withColumn("__bin", F.floor(F.col("__d") / FOLD))
    for _ in range(3):
        at = at.groupBy(*on, "__bin").agg(_divisor(F.collect_set("__d")).alias("__d")).withColumn("__bin", F.floor(F.col("__bin") / FOLD))
    return at.groupBy(*on).agg(F.greatest(_divisor(F.collect_set("__d")), F.lit(1).cast("long")).alias(name))


#: Values in a set that is folded at once, and the most divisions that Euclid's rule needs for two 64-bit numbers.
FOLD, DIVISIONS = 4096, 92


def _divisor(numbers: Column) -> Column:
    """Greatest common divisor of an array, 0 if it holds nothing but 0."""
    step = lambda p: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.coalesce(F.try_mod(p["a"], p["b"]), F.lit(0).cast("long")).cast("long").alias("b")))
    euclid = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(DIVISIONS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda p, _: step(p))["a"]
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda g, x: F.when(g == 1, g).otherwise(euclid(x, g)))


def numbered(df: DataFrame, order: list, name: str, buckets: list[Column | str]) -> DataFrame:
    """Rows numbered from 1 over the whole table without a sort of all in one task: counts per bucket are summed up first.

    `buckets` are columns or expressions that rise with `order` (a sequence id and a bin of places, say). Only one row per
    bucket goes through a single window.
    """
    keys = [f"__b{i}" for i in range(len(buckets))]
    kept = df.withColumns({k: F.col(b) if isinstance(b, str) else b for k, b in zip(keys, buckets, strict=True)})
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    before = before.select(*[F.col(k).alias(f"{k}_r") for k in keys], "__before")
    own = kept.withColumn("__row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return own.join(before, same).withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).select(*df.columns, name)
