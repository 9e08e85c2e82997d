"""The summary of a run's identifiers: one row for each locus, from its call, proposal records and both mappings.

Every field of every table becomes rows (locus, field, place, value), so that all of them are made distinct, ordered and joined in
one grouping, however many records a locus has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskit.functions import rules, text
from locuskit.operators import tables
from locuskit.operators.proposals import first_of

#: The note of each row, and the columns of the call that are kept as they are.
NOTE = "one row per locus; semicolon-separated fields may contain split/merge/provenance multiplicity"
KEPT = ("final_call", "call_group", "relation_to_current", "export_readiness")
#: Fields by origin: the column of the summary, the columns of a record of which the first that isn't empty counts, and the place
#: of proposal records, gene rows, transcript rows and the call among each other (absent: not read).
JOINED = {
    "retired_current_gene_ids": (("retired_current_gene_ids",), {"gene": 0}), "final_gene_ids": (("final_gene_id",), {"gene": 0}), "final_transcript_ids": (("final_transcript_id",), {"tx": 0}),
    "proposal_gene_ids": (("proposal_gene_id", "v2_proposal_gene_id", "export_gene_id"), {"gene": 0, "proposal": 1}), "proposal_transcript_ids": (("proposal_transcript_id", "v2_proposal_transcript_id", "export_transcript_id"), {"tx": 0, "proposal": 1}),
    "source": (("source",), {"proposal": 0, "gene": 1}), "source_gene_id": (("source_gene_id",), {"proposal": 0, "gene": 1}), "source_transcript_id": (("source_transcript_id",), {"proposal": 0, "tx": 1}), "source_model_id": (("source_model_id",), {"proposal": 0, "gene": 1}),
    "review_flags": (("review_flags",), {"proposal": 0}), "risk_tags": (("risk_tags",), {"call": 0, "proposal": 1}), "blocking_reasons": (("blocking_reasons",), {"call": 0, "proposal": 1}),
    "current_gene_ids": (("current_gene_ids", "removed_current_gene_ids"), {"proposal": 0, "gene": 1}), "relations": (("final_relation",), {"gene": 0}), "actions": (("proposal_action",), {"proposal": 0}),
}
LISTS, PROPOSED = ("current_gene_ids", "retired_current_gene_ids"), ("proposal_gene_ids", "proposal_transcript_ids")
INFO = ("source_sources", "source_gene_ids", "source_transcript_ids", "source_model_ids")


def _value(df: DataFrame, *names: str) -> Column:
    return first_of(*[F.col(n) for n in names if n in df.columns], F.lit(""))


def _items(df: DataFrame, kind: str, prefix: tuple[str, str]) -> DataFrame:
    """The rows of one table as items; its order is row_idx."""
    told = []
    for field, (names, places) in JOINED.items():
        if kind not in places:
            continue
        v = _value(df, *names)
        values = text.split_list(v) if field in LISTS else F.array(text.renamed_prefix(v, *prefix) if field in PROPOSED else v)
        told.append(F.struct(F.lit(field).alias("field"), F.lit(places[kind]).alias("major"), values.alias("values")))
    if kind == "gene":
        told.append(F.struct(F.lit("reuse_current_gene_ids").alias("field"), F.lit(0).alias("major"), F.array(F.when(_value(df, "reuse_current_gene_id") == "true", _value(df, "final_gene_id")).otherwise("")).alias("values")))
    each = df.select("locus_id", F.col("row_idx").cast("long").alias("row_idx"), F.explode(F.array(*told)).alias("x"))
    flat = each.select("locus_id", "row_idx", "x.field", "x.major", F.posexplode("x.values").alias("pos", "value"))
    return flat.select("locus_id", "field", F.struct("major", "row_idx", "pos").alias("place"), "value")


def identifier_summary(
    calls: DataFrame, models: DataFrame, proposals: DataFrame, genes: DataFrame, transcripts: DataFrame, with_current: bool = True, prefix: tuple[str, str] = ("V2PROP_", "Proposal_")
) -> DataFrame:
    """One row for each call (one a locus_id), all text, lists joined by semicolons in order of their first appearance.

    `models` has locus_id, model_id and where it comes from (source, source_gene_id, gene_id, source_transcript_id,
    transcript_id); a selected model that it doesn't name is read from its identifier. `proposals`, `genes` and `transcripts`
    have locus_id and row_idx, their order; columns that a table lacks, nulls and blanks are empty. Without records a locus has
    empty lists. `with_current=False` is a run without a current annotation. `prefix` is the inner and the shown start of a
    proposal's identifier.
    """
    ids = text.split_list(_value(calls, "selected_real_model_ids", "selected_model_id"))
    picked = calls.select("locus_id", F.posexplode(ids).alias("pos", "model_id"))
    known = models.select("locus_id", "model_id", *[_value(models, *names).alias(n) for n, names in (("m_source", ("source",)), ("m_gene", ("source_gene_id", "gene_id")), ("m_tx", ("source_transcript_id", "transcript_id")))])
    part = lambda i: F.coalesce(F.get(F.split("model_id", ":", 3), F.lit(i)), F.lit(""))
    info = [first_of(F.col("m_source"), part(0)), first_of(F.col("m_gene"), part(1)), first_of(F.col("m_tx"), part(2)), F.col("model_id")]
    place = F.struct(F.lit(0).alias("major"), F.col("pos").cast("long").alias("row_idx"), F.lit(0).alias("pos"))
    own = picked.join(known, ["locus_id", "model_id"], "left").select("locus_id", place.alias("place"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in zip(INFO, info, strict=True)])).alias("x"))
    every = own.select("locus_id", "x.field", "place", "x.value")
    for kind, df in (("call", calls.withColumn("row_idx", F.lit(0))), ("proposal", proposals), ("gene", genes), ("tx", transcripts)):
        every = every.unionByName(_items(df, kind, prefix))
    fields = [*JOINED, "reuse_current_gene_ids", *INFO]
    joined = tables.joined_fields(every, ["locus_id"], fields).select("locus_id", *[F.col(f).alias(f"j_{f}") for f in fields])
    whole = calls.join(joined, "locus_id", "left")
    of = lambda f: F.coalesce(F.col(f"j_{f}"), F.lit(""))
    call, relation = _value(calls, "final_call"), _value(calls, "relation_to_current")
    change = rules.change_class(of("relations"), of("actions"), call, relation) if with_current else F.lit(rules.WITHOUT_CURRENT[0])
    row_field = dict(zip(INFO, ("source", "source_gene_id", "source_transcript_id", "source_model_id"), strict=True))
    out = whole.withColumn("change_class", change)
    return out.select(
        F.lit("correction" if with_current else "arbitration").alias("workflow_mode"), "locus_id", "change_class", *[_value(calls, c).alias(c) for c in KEPT], of("current_gene_ids").alias("current_gene_ids"), of("retired_current_gene_ids").alias("retired_current_gene_ids"), of("reuse_current_gene_ids").alias("reuse_current_gene_ids"),
        F.when((of("final_gene_ids") == "") & (F.col("change_class") == "keep_current"), of("current_gene_ids")).otherwise(of("final_gene_ids")).alias("final_gene_ids"), of("final_transcript_ids").alias("final_transcript_ids"),
        of("proposal_gene_ids").alias("proposal_gene_ids"), of("proposal_transcript_ids").alias("proposal_transcript_ids"), _value(calls, "selected_real_set_id", "gene_set_selected_set_id", "selected_set_id").alias("selected_set_id"), _value(calls, "selected_source").alias("selected_source"),
        of("source_model_ids").alias("selected_model_ids"), *[F.when(of(f) != "", of(f)).otherwise(of(r)).alias(f) for f, r in row_field.items()],
        rules.change_meaning(F.col("change_class")).alias("replacement_interpretation"), of("review_flags").alias("review_flags"), of("risk_tags").alias("risk_tags"), of("blocking_reasons").alias("blocking_reasons"), F.lit(NOTE).alias("notes"),
    )
