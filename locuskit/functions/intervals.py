"""Closed, 1-based intervals: expressions on scalars and on arrays of struct<start,end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared positions of two intervals, 0 if none."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)


def length(blocks: Column) -> Column:
    """Sum of block lengths (blocks that overlap count each)."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + (b["end"] - b["start"] + 1).cast("long"))


def ordered(blocks: Column) -> Column:
    return F.array_sort(F.array_distinct(blocks))


def introns(blocks: Column) -> Column:
    """What lies between neighbouring sorted blocks; start > end where they touch or overlap."""
    after = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))), after, lambda a, b: F.struct((a["end"] + 1).alias("start"), (b["start"] - 1).alias("end")))
    return F.when(F.size(blocks) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def proper_introns(blocks: Column) -> Column:
    return F.filter(introns(blocks), lambda i: i["start"] < i["end"])


def sites(gaps: Column) -> Column:
    """Distinct ends of introns."""
    return F.array_distinct(F.flatten(F.transform(gaps, lambda i: F.array(i["start"], i["end"]))))


def shown(blocks: Column) -> Column:
    """Blocks as `start-end` joined by commas."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["start"].cast("string"), F.lit("-"), b["end"].cast("string"))), ",")


def signature(seqid: Column, strand: Column, blocks: Column) -> Column:
    return F.concat_ws("|", seqid, strand, shown(blocks))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union))


def merged(blocks: Column) -> Column:
    """Blocks joined where they overlap or touch, in order."""
    empty = F.slice(blocks, 1, 0)
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, b: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], b["end"]).alias("end"))))
    return F.aggregate(F.array_sort(blocks), empty, lambda acc, b: F.when((F.size(acc) > 0) & (b["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + 1), join(acc, b)).otherwise(F.concat(acc, F.array(b))))


def set_overlap(a: Column, b: Column) -> Column:
    """Shared positions of two sets of disjoint blocks."""
    one = lambda x: F.aggregate(b, F.lit(0).cast("long"), lambda n, y: n + overlap(x["start"], x["end"], y["start"], y["end"]).cast("long"))
    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + one(x))


def nested(inner: Column, outer: Column) -> Column:
    """Each inner block lies within some outer block."""
    return F.forall(inner, lambda i: F.exists(outer, lambda o: (o["start"] <= i["start"]) & (i["end"] <= o["end"])))


def coding_order(cds: Column, strand: Column) -> Column:
    return F.when(strand == "-", F.reverse(F.array_sort(cds))).otherwise(F.array_sort(cds))


def phases(cds: Column, strand: Column) -> Column:
    """Phase of each coding block in transcript order: what the running length leaves of a codon."""
    step = lambda acc, b: F.struct((acc["n"] + b["end"] - b["start"] + 1).cast("long").alias("n"), F.concat(acc["p"], F.array(((3 - acc["n"] % 3) % 3).cast("int"))).alias("p"))
    return F.aggregate(coding_order(cds, strand), F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("p")), step)["p"]
