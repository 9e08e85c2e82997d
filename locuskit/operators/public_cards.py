"""Cards without the names of sources: aliases, nested projections by allow-lists, and canonical dumps.

What a public card shows is listed; whatever else a set or model carries never gets there. Aliases are numbered by a window
over the sets (or models) of one locus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskit.functions import text

#: The tag that is never shown, and the word that tags of an annotation from scratch must not hold.
HIDDEN, TOLD = "not_available_for_de_novo_model", "current"
#: Columns that a public set and a public model show as they are, where the table has them.
SET_SHOWN = ("gene_count", "transcript_count", "validation_summary", "short_read_junction_summary", "protein_supported_model_count", "homolog_protein_summary", "optional_evidence_slots", "evidence_levels", "candidate_set_mode")
MODEL_SHOWN = ("exon_count", "cds_length", "validation_status", "rna_junction_status", "protein_support_count")
LONG_SHOWN = {"status": "string", "exact_supported_transcripts": "long", "partial_supported_transcripts": "long", "unsupported_transcripts": "long", "mono_exon_not_assessable_count": "long", "conflicting_chain_count": "long"}
DIFFERENCE_SHOWN = ("relation", "exon_delta", "cds_delta")


def public_tags(tags: Column, correction: bool) -> Column:
    """Sorted distinct tags without empty and hidden ones; from scratch also without those that speak of the current annotation."""
    fine = lambda x: (x != "") & (x != HIDDEN) & (F.lit(True) if correction else ~F.contains(F.lower(x), F.lit(TOLD)))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), fine)))


def aliased(df: DataFrame, kind: str, order: str, correction: bool) -> DataFrame:
    """`alias` for the sets or models (kind) of each locus_id, numbered by `order`.

    In a correction the current set is called so, current models are numbered by themselves, and the others are candidates by
    letters (sets) or numbers (models); else all are S01, S02 and on, or M01, M02 and on.
    """
    is_current = F.col("source") == "current"
    own = W.partitionBy("locus_id", is_current).orderBy(order)
    n = F.row_number().over(own if correction else W.partitionBy("locus_id").orderBy(order))
    if not correction:
        return df.withColumn("alias", text.numbered_id("S" if kind == "set" else "M", n, 2))
    if kind == "set":
        name = F.when(is_current, "current_set").otherwise(F.concat(F.lit("candidate_set_"), text.letters(n)))
    else:
        name = F.when(is_current, text.numbered_id("current_model_", n, 2)).otherwise(text.numbered_id("candidate_model_", n, 2))
    return df.withColumn("alias", name)


def _shown(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def public_long_reads(summary: Column) -> Column:
    """The listed fields of a summary struct; `not_configured` and zeros where it is null."""
    given = lambda k, kind: F.coalesce(summary[k].cast(kind), F.lit("not_configured" if kind == "string" else 0).cast(kind)).alias(k)
    return F.struct(*[given(k, kind) for k, kind in LONG_SHOWN.items()])


def public_models(models: DataFrame, correction: bool) -> DataFrame:
    """One row per model: locus_id, model_id (the real one), `alias`, and `public`, what a card shows of it.

    Models have locus_id, pos, model_id, source, risk_tags, hard_flags, any of MODEL_SHOWN, and may have `difference`, a struct
    with closest_current_model_id and DIFFERENCE_SHOWN, which only a correction shows, with the alias of that model.
    """
    a = aliased(models, "model", "pos", correction)
    fields = [F.col("alias").alias("model_id"), F.when((F.col("source") == "current") & F.lit(correction), "current_model").otherwise("candidate_model").alias("model_role"), *_shown(models, MODEL_SHOWN), *[public_tags(F.col(c), correction).alias(c) for c in ("risk_tags", "hard_flags")]]
    if correction and "difference" in models.columns:
        near = a.select("locus_id", F.col("model_id").alias("near"), F.col("alias").alias("near_alias"))
        a = a.withColumn("near", F.col("difference.closest_current_model_id")).join(near, ["locus_id", "near"], "left")
        fields.append(F.struct(F.coalesce("near_alias", F.lit("")).alias("closest_current_model_id"), *[F.col(f"difference.{c}") for c in DIFFERENCE_SHOWN]).alias("difference_from_current"))
    return a.select("locus_id", "model_id", "alias", F.struct(*fields).alias("public"))


def public_sets(sets: DataFrame, models: DataFrame, correction: bool) -> DataFrame:
    """One row per set: locus_id, set_id, `alias`, `public`; `models` are rows of `public_models`.

    Sets have locus_id, pos, set_id, source, model_ids, risk_tags, hard_flags, supporting_sources, equivalent_source_set_ids,
    any of SET_SHOWN, and may have long_read_summary. Sources and equal sets are counted and numbered, never named; a model
    that the card doesn't have is left out.
    """
    a = aliased(sets, "set", "pos", correction)
    at = a.select("locus_id", "set_id", F.posexplode("model_ids").alias("at", "model_id")).join(models.select("locus_id", "model_id", F.col("alias").alias("model")), ["locus_id", "model_id"])
    named = at.groupBy("locus_id", "set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("named"))
    some = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "")
    listed = lambda c, word: F.transform(some(c), lambda x, i: F.concat(F.lit(word), F.lpad((i + 1).cast("string"), 2, "0")))
    is_current = (F.col("source") == "current") & F.lit(correction)
    n = F.row_number().over(W.partitionBy("locus_id").orderBy("pos"))
    label = F.when(is_current, "current").otherwise(F.replace("alias", F.lit("candidate_set_"), F.lit("candidate_")) if correction else text.numbered_id("candidate_", F.col("n"), 2))
    long = [public_long_reads(F.col("long_read_summary")).alias("long_read_summary")] if "long_read_summary" in sets.columns else []
    fields = [
        F.col("alias").alias("set_id"), F.when(is_current, "current_gene_set").otherwise("candidate_gene_set").alias("set_role"), label.alias("candidate_label"), F.coalesce("named", F.array().cast("array<string>")).alias("model_ids"),
        F.size(some("supporting_sources")).alias("supporting_source_count"), listed("supporting_sources", "source_").alias("supporting_sources"), F.when(F.size(some("supporting_sources")) > 0, "source_01").otherwise("").alias("representative_source"),
        F.size(some("equivalent_source_set_ids")).alias("equivalent_source_set_count"), listed("equivalent_source_set_ids", "equivalent_source_set_").alias("equivalent_source_set_ids"),
        *_shown(sets, SET_SHOWN), *long, *[public_tags(F.col(c), correction).alias(c) for c in ("risk_tags", "hard_flags")],
    ]
    return a.withColumn("n", n).join(named, ["locus_id", "set_id"], "left").select("locus_id", "set_id", "alias", F.struct(*fields).alias("public"))


def public_cards(sets: DataFrame, models: DataFrame, correction: bool = True) -> DataFrame:
    """One row per locus: locus_id, `sets` and `models` as arrays of structs in the order of their aliases, and `card`, the
    canonical dump of both. A locus without sets or without models has an empty array there."""
    m = public_models(models, correction)
    s = public_sets(sets, m, correction)
    held = lambda df, name: df.groupBy("locus_id").agg(F.array_sort(F.collect_list("public")).alias(name))
    both = held(s, "sets").join(held(m, "models"), "locus_id", "full_outer")
    both = both.select("locus_id", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("sets", "models")])
    whole = F.struct("sets", "models")
    return both.withColumn("card", canonical(whole, T.StructType([both.schema["sets"], both.schema["models"]])))


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON with the keys of every struct sorted and nulls written out; letters of any script stay as they are."""
    return F.to_json(_sorted(value, kind), {"ignoreNullFields": "false"})


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        made = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def difference_keys(a: Column, b: Column) -> Column:
    """struct<only_left, only_right> of two arrays of keys, which may be nested: sorted, distinct."""
    side = lambda x, y: F.array_sort(F.array_except(x, y))
    return F.struct(side(a, b).alias("only_left"), side(b, a).alias("only_right"))
