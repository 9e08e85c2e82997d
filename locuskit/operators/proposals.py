"""The proposal catalogue: for each locus what is to be done, and the selected models as GFF features and records.

Cards and calls are keyed tables of which the last row of a key counts. Genes and transcripts of a locus are numbered by
windows over the locus; features come from explodes of a model's blocks, and the catalogue is sorted by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules, text
from locuskit.session import written
from locuskit.sources import readers

#: The rank of a feature at one place (others 50), what a catalogue says of itself, and the note of a record.
RANKS = {"gene": 0, "mrna": 1, "transcript": 1, "rna": 1, "exon": 2, "cds": 3}
STATUS = (("proposal_catalog", "true"), ("proposal_status", "not_final_annotation"))
COPIED, RETAINED = "candidate coordinates copied from full card; CDS phase recomputed", "current backbone retained; no candidate GFF record exported for this locus"
#: Columns of a call that records and features repeat.
TOLD = ("final_call", "call_group", "relation_to_current", "export_readiness", "selected_source", "risk_tags", "blocking_reasons")
#: Columns of a call, all text.
CALL = (*TOLD, "decision", "selected_model_id", "selected_real_model_ids", "selected_real_set_id", "gene_set_selected_set_id", "selected_id", "manual_review_novel_gene_candidate", "manual_review_deletion_candidate", "manual_review_unsupported_locus")


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def model_parts(ident: Column) -> Column:
    """struct<source, gene, tx> of a model id source:gene:transcript; with fewer parts the last stands for what is missing."""
    p = F.split(F.coalesce(ident, F.lit("")), ":", 3)
    of = lambda a, b, c: F.struct(a.alias("source"), b.alias("gene"), c.alias("tx"))
    return F.when(F.size(p) == 3, of(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)))).when(F.size(p) == 2, of(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(1)))).otherwise(of(F.lit(""), F.get(p, F.lit(0)), F.get(p, F.lit(0))))


def attributes(pairs: list[tuple[str, Column | str]]) -> Column:
    """`k=v;k=v` with quoted values, without empty ones."""
    shown = [F.when(first_of(v) != "", F.concat(F.lit(f"{k}="), text.quoted(v))) for k, v in ((k, F.lit(v) if isinstance(v, str) else v.cast("string")) for k, v in pairs)]
    return F.concat_ws(";", *shown)


def _token(c: Column) -> Column:
    return F.coalesce(F.nullif(text.safe_id(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("unknown"))


def selected_models(cards: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loci, models, selected) of cards (locus_id, candidate_models, row_idx) and calls (locus_id, CALL, row_idx).

    loci: one row a locus that has a card, its call (empty where it has none), `current` gene ids, `flags`, `set_id`, `wanted`
    model ids, `missing` of them, and `action`. models: a row for each model of a card, of equal ids the last. selected: the
    wanted models in their order. A kept locus without named models selects its current ones.
    """
    last = lambda df: readers.last_of_key(df.filter("locus_id <> ''"), "locus_id")
    card, call = last(cards), last(calls)
    models = card.select("locus_id", F.posexplode("candidate_models").alias("pos", "m")).select("locus_id", "pos", "m.*").filter("model_id <> ''")
    first = models.groupBy("locus_id", "model_id").agg(F.min("pos").alias("first"), F.max_by(F.struct(*[c for c in models.columns if c not in ("locus_id", "model_id", "pos")]), "pos").alias("m"))
    parts = model_parts(F.col("model_id"))
    known = first.select("locus_id", "model_id", "first", "m.*").withColumns({"own": first_of(F.col("source"), parts["source"]), "own_gene": first_of(F.col("source_gene_id"), F.col("gene_id"), parts["gene"]), "own_tx": first_of(F.col("source_transcript_id"), F.col("transcript_id"), parts["tx"])})
    models, _ = written(known, "card-models")
    current = models.filter("own = 'current'").groupBy("locus_id").agg(F.array_sort(F.collect_set(F.when(F.col("own_gene") != "", F.col("own_gene")))).alias("current"), F.transform(F.array_sort(F.collect_list(F.struct("first", "model_id"))), lambda x: x["model_id"]).alias("held"))
    told = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in CALL]
    joined = card.select("locus_id").join(call.withColumn("called", F.lit(True)), "locus_id", "left").join(current, "locus_id", "left")
    none = F.array().cast("array<string>")
    one = joined.select("locus_id", F.coalesce("called", F.lit(False)).alias("called"), *told, F.coalesce("current", none).alias("current"), F.coalesce("held", none).alias("held"))
    ids = text.split_list(first_of(F.col("selected_model_id"), F.col("selected_real_model_ids")))
    ids = F.when((F.size(ids) == 0) & F.col("final_call").isin("keep_current", "keep_current_flagged"), F.col("held")).otherwise(ids)
    yes = lambda c: F.lower(c) == "true"
    flags = rules.review_flags(F.col("final_call"), F.col("call_group"), F.col("decision"), F.col("export_readiness"), F.col("blocking_reasons") != "", yes("manual_review_novel_gene_candidate"), yes("manual_review_deletion_candidate"), yes("manual_review_unsupported_locus"))
    one = one.withColumns({"wanted": ids, "flags": F.array_join(F.array_sort(F.array_distinct(flags)), ";"), "set_id": first_of(F.col("selected_real_set_id"), F.col("gene_set_selected_set_id"), F.col("selected_id"))}).drop("held")
    one, _ = written(one, "calls")
    picked = one.select("locus_id", F.posexplode("wanted").alias("at", "model_id")).join(models, ["locus_id", "model_id"])
    counts = picked.groupBy("locus_id").agg(F.count("*").alias("n"), F.bool_and(F.col("own") == "current").alias("all_current"))
    n = F.coalesce("n", F.lit(0))
    action = rules.proposal_action(F.col("final_call"), n, F.coalesce("all_current", F.lit(False)), F.size("current"))
    loci = one.join(counts, "locus_id", "left").withColumns({"action": action, "missing": (F.size("wanted") - n).cast("long")}).drop("n", "all_current")
    return written(loci, "loci")[0], models, written(picked, "selected")[0]


def catalogue(cards: DataFrame, calls: DataFrame, label: str = "proposal", prefix: str = "Proposal") -> dict[str, DataFrame]:
    """`features` (GFF columns and attributes), `records`, `review` rows, `removed` current genes and the `loci` themselves.

    Blocks of a model are arrays of struct<start, end>. A locus that replaces or adds has its selected models grouped by gene,
    sequence and strand, genes numbered by place, transcripts by start; phases are computed anew. The others have one record
    without coordinates.
    """
    loci, _, selected = selected_models(cards, calls)
    made = loci.filter("action in ('replace_current_with_selected_set', 'add_novel_selected_set')")
    span = lambda f, own, *blocks: f(F.filter(F.concat(F.array(own.cast("long")), *[F.transform(F.coalesce(F.col(b), F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: x[own_name(f)].cast("long")) for b in blocks]), lambda x: x != 0))
    own_name = lambda f: "start" if f is F.array_min else "end"
    strand = F.coalesce(F.nullif(F.col("strand"), F.lit("")), F.lit("."))
    m = selected.join(made.select("locus_id"), "locus_id", "left_semi").withColumns({"key": first_of(F.col("own_gene"), F.col("model_id")), "strand": strand, "seqid": F.coalesce("seqid", F.lit("")), "low": span(F.array_min, F.col("start"), "exons", "cds"), "high": span(F.array_max, F.col("end"), "exons", "cds"), "start": F.coalesce(F.col("start").cast("long"), F.lit(0))})
    group = ["locus_id", "key", "seqid", "strand"]
    genes = m.groupBy(*group).agg(
        F.min("start").alias("first"), F.coalesce(F.min("low"), F.lit(0)).alias("g_start"), F.coalesce(F.max("high"), F.lit(0)).alias("g_end"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("own_gene") != "", F.col("own_gene")))), ",").alias("genes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "model_id"))), lambda x: x["model_id"]), ",").alias("ids"),
    )
    genes = genes.withColumn("g", F.row_number().over(W.partitionBy("locus_id").orderBy("first", "key", "seqid", "strand"))).join(made, "locus_id")
    name = F.concat(F.lit(f"{prefix}_"), _token(F.col("locus_id")), F.lit("_"), _token(F.col("set_id")), F.lit("_g"), text.numbered_id("", F.col("g"), 2))
    replaced = F.when(F.col("action") == "replace_current_with_selected_set", F.array_join("current", ";")).otherwise("")
    genes, _ = written(genes.withColumns({"gene": name, "removed": replaced}), "proposed-genes")
    c = F.col
    gene_rows = genes.select(
        "seqid", F.lit("gene").alias("feature"), c("g_start").alias("start"), c("g_end").alias("end"), "strand", F.lit(".").alias("phase"),
        attributes([("ID", c("gene")), ("Name", c("gene")), *STATUS, ("locus_id", c("locus_id")), ("proposal_action", c("action")), ("selected_set_id", c("set_id")), ("selected_source", c("selected_source")), ("source_gene_id", c("genes")), ("source_model_id", c("ids")), ("replaces_current_genes", c("removed")), ("final_call", c("final_call")), ("call_group", c("call_group")), ("relation_to_current", c("relation_to_current")), ("export_readiness", c("export_readiness")), ("review_flags", c("flags")), ("risk_tags", c("risk_tags")), ("blocking_reasons", c("blocking_reasons"))]).alias("attributes"),
    )
    k = F.row_number().over(W.partitionBy(*group).orderBy("start", "model_id", "at"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    bare = lambda x: F.transform(F.coalesce(c(x), none), lambda b: F.struct(b["start"].cast("long").alias("start"), b["end"].cast("long").alias("end")))
    coded = intervals.coding_order(bare("cds"), c("strand"))
    tx = m.withColumns({"k": k, "cds": bare("cds"), "coded": F.arrays_zip(coded.alias("b"), intervals.phases(bare("cds"), c("strand")).alias("p")), "exons": F.when(F.size(bare("exons")) > 0, bare("exons")).otherwise(bare("cds"))})
    tx = tx.join(genes.drop("wanted", "first"), group).withColumn("tx", F.concat("gene", F.lit(".t"), text.numbered_id("", c("k"), 2))).withColumns({"t_start": F.coalesce("low", "g_start"), "t_end": F.coalesce("high", "g_end")})
    tx, _ = written(tx, "proposed-transcripts")
    tx_rows = tx.select(
        "seqid", F.lit("mRNA").alias("feature"), c("t_start").alias("start"), c("t_end").alias("end"), "strand", F.lit(".").alias("phase"),
        attributes([("ID", c("tx")), ("Parent", c("gene")), ("Name", c("tx")), *STATUS, ("locus_id", c("locus_id")), ("selected_set_id", c("set_id")), ("source_model_id", c("model_id")), ("source", c("own")), ("source_gene_id", c("own_gene")), ("source_transcript_id", c("own_tx")), ("review_flags", c("flags"))]).alias("attributes"),
    )
    part = lambda kind: attributes([("ID", F.concat("tx", F.lit(f".{kind}"), (c("i") + 1).cast("string"))), ("Parent", c("tx"))])
    exon_rows = tx.select("seqid", "strand", "tx", F.posexplode(F.array_sort(F.array_distinct("exons"))).alias("i", "b")).select("seqid", F.lit("exon").alias("feature"), "b.start", "b.end", "strand", F.lit(".").alias("phase"), part("exon").alias("attributes"))
    sorted_ = F.array_sort(F.transform("coded", lambda z: F.struct(z["b"]["start"].alias("start"), z["b"]["end"].alias("end"), z["p"].cast("string").alias("phase"))))
    cds_rows = tx.select("seqid", "strand", "tx", F.posexplode(sorted_).alias("i", "b")).select("seqid", F.lit("CDS").alias("feature"), "b.start", "b.end", "strand", "b.phase", part("cds").alias("attributes"))
    features = gene_rows.union(tx_rows).union(exon_rows).union(cds_rows).withColumns({"source": F.lit(label), "score": F.lit(".")})

    of_locus = ["locus_id", c("action").alias("proposal_action"), *TOLD, c("set_id").alias("selected_set_id"), "selected_model_id", F.array_join("current", ";").alias("current_gene_ids"), c("flags").alias("review_flags")]
    records = tx.select(
        *of_locus, c("removed").alias("removed_current_gene_ids"), c("gene").alias("export_gene_id"), c("tx").alias("export_transcript_id"), c("model_id").alias("source_model_id"), c("own").alias("source"), c("own_gene").alias("source_gene_id"), c("own_tx").alias("source_transcript_id"),
        "seqid", c("t_start").alias("start"), c("t_end").alias("end"), "strand", F.size("exons").alias("exon_count"), F.size("cds").alias("cds_count"), F.coalesce(intervals.length(c("cds")), F.lit(0)).cast("long").alias("cds_length"), F.lit(COPIED).alias("notes"),
    )
    rest = loci.join(made.select("locus_id"), "locus_id", "left_anti").select(*of_locus, F.lit("").alias("removed_current_gene_ids"), F.lit(RETAINED).alias("notes"))
    removed = made.filter("action = 'replace_current_with_selected_set'").select(F.explode("current").alias("gene_id")).distinct()
    review = loci.filter("flags <> ''").select(*of_locus)
    return {"features": features, "records": records.unionByName(rest, allowMissingColumns=True), "review": review, "removed": removed, "loci": loci}


def catalogue_order(features: DataFrame) -> DataFrame:
    """By sequence as text, place, rank of the feature, attributes."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.lower("feature")), F.lit(50))
    return features.orderBy("seqid", "start", "end", rank, "attributes")


def catalogue_summary(made: dict[str, DataFrame]) -> DataFrame:
    """metric and value of a catalogue: loci, missing calls and models, records, actions and calls by name."""
    loci = made["loci"]
    count = lambda df, name, value=None: df.agg((F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))).cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        count(loci, "card_loci"), count(loci.filter("not called"), "missing_call_loci"), count(made["features"], "proposal_gff_new_records"), count(made["records"].filter("export_transcript_id is not null"), "proposal_transcript_records"),
        count(made["removed"], "removed_current_genes"), count(loci, "missing_selected_models", F.col("missing")), count(made["review"], "review_flag_loci"),
        loci.groupBy(F.concat(F.lit("action:"), "action").alias("metric")).agg(F.count("*").alias("value")),
        loci.groupBy(F.concat(F.lit("final_call:"), F.when(F.col("called"), F.col("final_call")).otherwise("missing_final_call")).alias("metric")).agg(F.count("*").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
