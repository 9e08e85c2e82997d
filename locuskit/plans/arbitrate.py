"""One run from files to a merged annotation: candidates, evidence, loci, scores, decisions, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules, text
from locuskit.operators import cards, components, eligibility, evidence, islands
from locuskit.session import written
from locuskit.sources import evidence_tables, readers, writers

JUNCTION_SCHEMA = "seqid string, start long, `end` long, strand string, sample string, reads long, hang long"
#: Kinds of edges that alone don't make a long locus one place.
WEAK = ("span_overlap", "protein_bridge", "RNA_junction_bridge")
HIT_SCHEMA = "hit_id string, seqid string, strand string, start long, `end` long"


def candidates(spark: SparkSession, gffs: dict[str, str]) -> DataFrame:
    """Models of all sources, by label and path of a GFF3 or GTF file each: tx_id is source:gene:transcript."""
    parts = [readers.gff_models(readers.gff_rows(readers.lines(spark, path))).withColumn("source", F.lit(label)) for label, path in gffs.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    blocks = intervals.ordered(F.col("exons"))
    bare = intervals.ordered(F.transform("cds", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    ident = F.concat_ws(":", text.safe_id(F.col("source")), text.safe_id(F.col("gene_id")), text.safe_id(F.col("tx_id")))
    made = whole.filter("start is not null").select(ident.alias("tx_id"), "source", "gene_id", "seqid", "strand", "start", "end", blocks.alias("blocks"), F.coalesce(bare, F.array().cast("array<struct<start:long,end:long>>")).alias("coding"), F.when(F.size("cds") > 0, F.transform(intervals.coding_order(F.col("cds"), F.col("strand")), lambda b: b["phase"].try_cast("int"))).alias("phases"))
    return written(made.withColumn("gaps", intervals.proper_introns(F.col("blocks"))), "candidates")[0]


def arbitrate(
    models: DataFrame, observed: DataFrame, hits: DataFrame, priority: list[str], rule: str = "first_listed", chunks: DataFrame | None = None, long_models: DataFrame | None = None, long_genes: DataFrame | None = None, active: frozenset[str] = frozenset({"short_read", "protein"}), validation: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables of a run: junctions, audit, status, edges, loci, windows, sets, calls, proposals.

    `rule` chooses a set of each locus: "first_listed" takes the source of highest priority, "recommended" the best score
    (ties by priority). Sources that `priority` doesn't name come last, by name. With `chunks` (sequences), models are audited
    first, and those that fail take no part, nor do models of different genes of one source that share nine tenths of either;
    without, a summary made elsewhere counts as the audit (`validation`: tx_id, quality, eligible; models it doesn't name stay),
    else none is assessed. `windows` has the size of each locus and its risks. `long_models` (source, transcript, support, conflicts,
    risks) and `long_genes` (see cards.long_read_sets) are support by long reads. `active` are the kinds of evidence of the run.
    """
    spark = models.sparkSession
    every = models
    audit = models.select("tx_id", F.lit("not_assessed").alias("quality"), F.lit(True).alias("eligible"))
    if chunks is not None:
        judged = eligibility.with_conflicts(eligibility.audited_on(models, chunks), evidence.neighbour_conflicts(models), "tx_id")
        audit, _ = written(judged.withColumnRenamed("status", "quality"), "audit")
    elif validation is not None:
        told = validation.select("tx_id", F.col("quality").alias("q"), F.col("eligible").alias("e"))
        audit, _ = written(models.select("tx_id").join(told, "tx_id", "left").select("tx_id", F.coalesce("q", F.lit("not_assessed")).alias("quality"), F.coalesce("e", F.lit(True)).alias("eligible")), "audit")
    if chunks is not None or validation is not None:
        models, _ = written(models.join(audit.filter("eligible").select("tx_id"), "tx_id", "left_semi"), "eligible")
    ok = evidence.supported(evidence.merged_junctions(observed))
    introns = models.select("tx_id", "seqid", "strand", F.explode("gaps").alias("g")).select("tx_id", "seqid", "strand", "g.*")
    status, _ = written(evidence.arbitration_status(models, introns, ok, "tx_id").join(evidence.protein_support(models, hits, "tx_id").select("tx_id", "hits"), "tx_id", "left"), "status")
    edges = evidence.structural_edges(models).union(evidence.gene_edges(models)).union(evidence.protein_bridges(models, hits).select("a", "b", "kind")).union(evidence.junction_bridges(models, ok).select("a", "b", "kind"))
    edges, _ = written(edges, "edges")
    roots = components.components(models.select(F.col("tx_id").alias("node")), edges)
    placed = models.join(roots.withColumnRenamed("node", "tx_id"), "tx_id")
    first = placed.groupBy("root").agg(F.min(F.struct("seqid", "start", "end", "tx_id")).alias("first")).select("root", "first.seqid", "first")
    loci, _ = written(islands.numbered(first, ["first"], "k", ["seqid", F.floor(F.col("first.start") / islands.BIN)]).select("root", text.numbered_id("locus_", F.col("k"), 8).alias("locus_id")), "loci")

    homes = placed.join(loci, "root").select("tx_id", "locus_id", "source", "gene_id", "start", "end")
    tied = edges.select(F.col("a").alias("tx_id"), F.col("kind").isin(*WEAK).alias("weak")).join(homes.select("tx_id", "locus_id"), "tx_id").groupBy("locus_id").agg(F.bool_and("weak").alias("weak"))
    sizes = homes.groupBy("locus_id").agg((F.max("end") - F.min("start") + 1).alias("span"), F.count("*").alias("models"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("source") == "current", F.col("gene_id"))).alias("current_genes"))
    risks = rules.window_risks(F.col("span"), F.col("current_genes"), F.col("models"), F.col("sources"), F.coalesce("weak", F.lit(False)))
    windows, _ = written(sizes.join(tied, "locus_id", "left").withColumn("window_risks", risks).drop("weak"), "windows")

    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    m = placed.join(loci, "root").join(status, "tx_id").join(audit.select("tx_id", "quality"), "tx_id").withColumn("hits", F.coalesce("hits", F.lit(0)))
    flags, risks, _ = rules.model_evidence(F.col("status"), F.col("introns"), F.col("alternatives"), F.col("hits"), F.size("coding"), F.size("blocks"), F.col("source"))
    state = F.lit("not_configured")
    if long_models is not None:
        sources = long_models.select("source").distinct().withColumn("__has", F.lit(True))
        m = m.withColumn("transcript", F.split("tx_id", ":", 3)[2]).join(long_models.select("source", "transcript", "support", "conflicts", F.col("risks").alias("long_risks"), F.lit(True).alias("__row")), ["source", "transcript"], "left").join(sources, "source", "left")
        state = F.when(F.col("__row"), "available").when(F.col("__has"), "missing_for_model").otherwise("not_available_for_source")
        more_flags, more_risks = rules.long_read_flags(state, F.col("support"), F.col("long_risks"))
        flags, risks = F.array_union(flags, more_flags), F.array_union(risks, more_risks)
    else:
        m = m.withColumns({"support": F.lit(""), "conflicts": F.lit(0), "long_risks": F.array().cast("array<string>")})
    m, _ = written(m.withColumns({"long_state": state, "flags": flags, "risks": risks}), "evidence")
    genes = spark.createDataFrame([], "source string, gene_id string, level string, exact long, partial long, unsupported long, conflicts long, best array<string>, risks array<string>") if long_genes is None else long_genes
    by_model = m.select(F.col("locus_id").alias("locus"), "source", "gene_id", F.col("long_state").alias("status"), F.coalesce("support", F.lit("")).alias("support"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.col("long_risks").alias("risks"))
    long = cards.long_read_sets(by_model, genes).select(F.col("locus").alias("locus_id"), "source", F.col("status").alias("long_status"), F.col("exact"), F.col("partial").alias("long_partial"), "unsupported", "mono", F.col("conflicts").alias("long_conflict"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = m.groupBy("locus_id", "source").agg(
        F.count("*").alias("models"), is_("full_junction_support").alias("full"), is_("partial_junction_support").alias("partial"), is_("none_observed").alias("none"), is_("not_assessable").alias("junction_unknown"), is_("conflicting_junction").alias("conflict"),
        F.count_if(F.col("hits") > 0).alias("protein"), F.bool_or(F.size("coding") > 0).alias("coding_present"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("gene_id")).alias("genes"), F.array_sort(F.collect_set("tx_id")).alias("ids"),
        *[F.count_if(F.col("quality") == q).alias(q) for q in ("pass", "fail", "warning", "not_assessed")], F.size(F.array_distinct(F.flatten(F.collect_list("risks")))).alias("risks"),
        F.bool_or(F.array_contains("flags", "model_level_full_intron_chain_supported")).alias("full_chain"),
    ).join(long, ["locus_id", "source"])
    n = {k: F.col(k) for k in ("models", "pass", "fail", "warning", "not_assessed", "full", "partial", "none", "junction_unknown", "conflict", "protein", "exact", "long_partial", "mono", "unsupported", "long_conflict", "risks", "coding_present", "full_chain")}
    n |= {"long_known": F.col("long_status") == "available", "all_junctions": F.col("full") == F.col("models")}
    made = rules.score(n, active)
    sets = counts.withColumns({"score": made["run_level"], "tier": rules.tier(made["run_level"]), "priority": F.when(rank > 0, rank).otherwise(len(priority) + 1)})
    order = [F.col("priority"), F.col("source")] if rule == "first_listed" else [F.desc("score"), F.col("priority"), F.col("source")]
    by = W.partitionBy("locus_id")
    sets, _ = written(sets.withColumns({"set_id": F.concat(F.lit("S"), text.numbered_id("", F.row_number().over(by.orderBy("priority", "source")), 2)), "chosen": F.row_number().over(by.orderBy(*order)) == 1}), "sets")

    whole = sets.groupBy("locus_id").agg(F.count_if(F.col("source") == "current").alias("cur"), F.count_if(F.col("source") != "current").alias("tool"), F.flatten(F.collect_list(F.when(F.col("source") == "current", F.col("genes")))).alias("current_genes"))
    picked = sets.filter("chosen").join(whole, "locus_id")
    call = rules.final_call(F.lit("select_annotation_set"), F.lit(True), F.col("set_id"), F.lit(True), F.col("source") == "current", F.col("cur") == 0, F.lit(False))
    calls = picked.select("locus_id", "set_id", "source", "score", "tier", rules.route(F.col("cur"), F.col("tool")).alias("route"), *[v.alias(k) for k, v in call.items()], "models", "genes", "ids", "current_genes")
    action = rules.proposal_action(F.col("final_call"), F.col("models"), F.col("source") == "current", F.size("current_genes"))
    calls, _ = written(calls.withColumn("action", action).withColumn("relation", rules.relation(F.col("action"), F.size("current_genes"), F.size("genes"))), "calls")
    proposals = calls.filter("action in ('replace_current_with_selected_set', 'add_novel_selected_set')").select("locus_id", "action", F.explode("ids").alias("tx_id")).join(models, "tx_id")
    return {"junctions": ok, "audit": audit, "models": every, "status": status, "edges": edges, "loci": placed.join(loci, "root").select("tx_id", "locus_id"), "windows": windows, "sets": sets, "calls": calls, "proposals": proposals}


def merged(models: DataFrame, run: dict[str, DataFrame]) -> DataFrame:
    """The current models that stay, and the proposals, as GFF features with attributes."""
    gone = run["calls"].filter("action = 'replace_current_with_selected_set'").select(F.explode("current_genes").alias("gene_id")).distinct()
    kept = models.filter("source = 'current'").join(gone, "gene_id", "left_anti").select(models.columns)
    every = kept.unionByName(run["proposals"].select(models.columns))
    pair = lambda k, v: F.concat(F.lit(f"{k}="), text.encoded(v))
    gene = F.concat_ws(":", "source", "gene_id")
    genes = every.groupBy(gene.alias("g")).agg(F.min("seqid").alias("seqid"), F.min("source").alias("source"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"))
    genes = genes.select("seqid", "source", F.lit("gene").alias("feature"), "start", "end", "strand", F.lit(".").alias("phase"), pair("ID", F.col("g")).alias("attributes"))
    tx = every.select("seqid", "source", F.lit("mRNA").alias("feature"), "start", "end", "strand", F.lit(".").alias("phase"), F.concat_ws(";", pair("ID", F.col("tx_id")), pair("Parent", gene)).alias("attributes"))
    parent = pair("Parent", F.col("tx_id"))
    exon = every.select("seqid", "source", F.lit("exon").alias("feature"), F.explode("blocks").alias("b"), "strand", F.lit(".").alias("phase"), parent.alias("attributes"))
    coded = F.arrays_zip(intervals.coding_order(F.col("coding"), F.col("strand")).alias("b"), intervals.phases(F.col("coding"), F.col("strand")).alias("p"))
    cds = every.select("seqid", "source", F.explode(coded).alias("z"), "strand", parent.alias("attributes")).select("seqid", "source", F.lit("CDS").alias("feature"), F.col("z.b").alias("b"), "strand", F.col("z.p").cast("string").alias("phase"), "attributes")
    parts = exon.unionByName(cds).select("seqid", "source", "feature", "b.start", "b.end", "strand", "phase", "attributes")
    return genes.unionByName(tx).unionByName(parts).withColumn("score", F.lit("."))


def run_files(
    spark: SparkSession, gffs: dict[str, str], out: str, junctions: dict[str, str] | None = None, proteins: dict[str, str] | None = None, rule: str = "first_listed", fasta: str | None = None, long_reads: str | None = None, one_file: bool = False
) -> dict[str, DataFrame]:
    """Reads the files, arbitrates and writes `out`/merged.gff3, calls and junctions. The order of `gffs` is the priority;
    `current` comes first if it is among them.

    `fasta` are the sequences, against which models are audited; `long_reads` is a folder with a folder of support tables for
    each source. merged.gff3 is a folder of parts in order, unless `one_file`, which moves all rows to one task.
    """
    observed = spark.createDataFrame([], JUNCTION_SCHEMA)
    for sample, path in (junctions or {}).items():
        j = evidence_tables.junction_file(readers.lines(spark, path), F.lit(sample))
        observed = observed.unionByName(j.select(observed.columns))
    hits = spark.createDataFrame([], HIT_SCHEMA)
    for label, path in (proteins or {}).items():
        hits = hits.unionByName(readers.protein_hits(readers.gff_rows(readers.lines(spark, path)), label).select(hits.columns))
    models = candidates(spark, gffs)
    priority = sorted(gffs, key=lambda s: s != "current")
    chunks = written(readers.fasta(readers.lines(spark, fasta)), "sequences")[0] if fasta else None
    long_models, long_genes = evidence_tables.long_read_tables(spark, long_reads) if long_reads else (None, None)
    active = frozenset(k for k, given in (("short_read", junctions), ("protein", proteins), ("long_read", long_reads)) if given)
    run = arbitrate(models, observed, hits, priority, rule, chunks, long_models, long_genes, active)
    features = merged(models, run)
    run["features"] = features
    writers.write_lines(writers.in_order(features), writers.gff_line(F.col("attributes")), f"{out}/merged.gff3", one_file=one_file)
    listed = run["calls"].withColumns({c: F.array_join(c, ";") for c in ("genes", "ids", "current_genes")})
    writers.write_table(listed, f"{out}/calls", ["locus_id", "set_id", "source", "score", "tier", "route", "final_call", "call_group", "relation_to_current", "export_readiness", "action", "relation", "genes", "ids", "current_genes"])
    writers.write_table(run["junctions"], f"{out}/junctions", ["seqid", "start", "end", "strand", "reads", "hang", "samples", "names"])
    return run
