"""Steps over keyed tables that many stages share: which row of a key counts, what the rows of a key have in common, parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_key(df: DataFrame, on: list[str], *order: Column) -> DataFrame:
    """One whole row for each key, the first by `order` (ascending); combined before the shuffle, without a sort."""
    return df.groupBy(*on).agg(F.min_by(F.struct(*[c for c in df.columns if c not in on]), F.struct(*order)).alias("__r")).select(*on, "__r.*")


def top_of_key(df: DataFrame, on: list[str], n: int, name: str, *order: Column) -> DataFrame:
    """The first n rows of each key by `order`, numbered as `name`; Spark limits each key before the shuffle too."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*on).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def upserted(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` doesn't have. Null keys are keys too."""
    keys = new.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return old.join(keys, same, "left_anti").unionByName(new)


def preferred(tables: Sequence[DataFrame], on: str) -> DataFrame:
    """The full outer join of tables on a key; of a column that several have, the first table's value that isn't null."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns if c != on))
    whole, held = None, {c: [] for c in names}
    for i, t in enumerate(tables):
        part = t.select(on, *[F.col(c).alias(f"__{i}_{c}") for c in t.columns if c != on])
        for c in t.columns:
            if c != on:
                held[c].append(f"__{i}_{c}")
        whole = part if whole is None else whole.join(part, on, "full_outer")
    return whole.select(on, *[F.coalesce(*held[c]).alias(c) for c in names])


def parent_status(children: DataFrame, parents: DataFrame, parent: str, differ: Column) -> DataFrame:
    """`children` with `status`: missing_parent, other_strand where `differ` (a condition on both rows) holds, else ok.

    `parents` has one row for each value of `parent`; its other columns get the suffix `_p`.
    """
    p = parents.select(parent, *[F.col(c).alias(f"{c}_p") for c in parents.columns if c != parent], F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "missing_parent").when(differ, "other_strand").otherwise("ok")
    return children.join(p, parent, "left").withColumn("status", status).select(*children.columns, "status")


def differing(df: DataFrame, on: list[str], columns: dict[str, str]) -> DataFrame:
    """For each key and each of `columns` (name of the result to column), whether the key's rows hold several values."""
    return df.groupBy(*on).agg(*[(F.count_distinct(c) > 1).alias(name) for name, c in columns.items()])


def best_state(df: DataFrame, on: list[str], state: str, order: Sequence[str], name: str) -> DataFrame:
    """For each key the earliest of ordered states among its rows; null where it has none of them."""
    states = F.array(*map(F.lit, order))
    at = F.nullif(F.array_position(states, F.col(state)), F.lit(0))
    return df.groupBy(*on).agg(F.min(at).cast("int").alias("__at")).select(*on, F.get(states, F.col("__at") - 1).alias(name))


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """Place of a value in a list, from 1; values that aren't in it come right behind."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def agreement(df: DataFrame, on: list[str], profile: str, profiles: Sequence[str], answer: str) -> DataFrame:
    """For each key the number of rows of each profile (0 where it has none), and of distinct answers as `n`."""
    return df.groupBy(*on).agg(*[F.count_if(F.col(profile) == p).alias(p) for p in profiles], F.count_distinct(answer).alias("n"))


def name_mapping(df: DataFrame, on: list[str], name: str, old: Column) -> DataFrame:
    """For each key its distinct names in order, and how many names of old rows no other row has (`retired`)."""
    g = df.groupBy(*on).agg(F.array_sort(F.collect_set(name)).alias("names"), F.collect_set(F.when(old, F.col(name))).alias("__old"), F.collect_set(F.when(~old, F.col(name))).alias("__new"))
    return g.select(*on, "names", F.size(F.array_except("__old", "__new")).cast("long").alias("retired"))


def spans(models: DataFrame, gene: str = "gene_id", tx: str = "tx_id") -> DataFrame:
    """For each gene its span, the number of models, and their ids in order of start, then id."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", tx))), lambda x: x[tx])
    return models.groupBy(gene).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("models"), ids.alias("ids"))


def broken_rules(*checks: tuple[Column, str]) -> Column:
    """The words of all conditions that hold, in the order given, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, w) for c, w in checks])), ";")


def without_named(df: DataFrame, on: list[str], names: Column, removed: DataFrame, name: str) -> DataFrame:
    """Rows whose key has no row that names (an array) anything in `removed` (name): exploded names meet it in a join."""
    hit = df.select(*on, F.explode(names).alias(name)).join(removed.select(name).distinct(), name, "left_semi").select(*on).distinct()
    return df.join(hit, on, "left_anti")


def joined_fields(items: DataFrame, on: list[str], fields: Sequence[str], by: str = ";") -> DataFrame:
    """One row for each key with a column per field: the field's distinct values in order of their first place, joined.

    `items` has the key, field, place (anything that sorts) and value; blank values don't count. A value that comes often is
    combined before the shuffle.
    """
    firsts = items.withColumn("value", F.trim("value")).filter("value <> ''").groupBy(*on, "field", "value").agg(F.min("place").alias("place"))
    held = {f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("place", "value")))) for f in fields}
    return firsts.groupBy(*on).agg(*[F.array_join(F.transform(x, lambda i: i["value"]), by).alias(f) for f, x in held.items()])
