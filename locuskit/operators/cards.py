"""Decision cards: the annotation sets of a locus, collapsed, compared, and decided where a gate allows it.

All steps are groupings by locus (and set or component) and columns over them; arrays hold the sets of one locus, which are few
by nature (the sources of a run), never rows of the genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import rules

#: Sources that represent equal sets, in order; others come after them by set.
ORDER = ("current",)


def source_rank(source: Column, order: tuple[str, ...] = ORDER) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), source)
    return F.when(at > 0, at - 1).otherwise(len(order))


def _alike(c: Column | str) -> Column:
    """Whether a group holds one value: by its least and greatest, since several distinct counts would multiply the rows."""
    return F.min(c) == F.max(c)


def collapse(sets: DataFrame, order: tuple[str, ...] = ORDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sets of equal structure as one. `sets`: locus, set_id, source, cds and introns (sorted arrays that together are the key),
    exons, span, evidence (struct of rules.EVIDENCE), fit, risks.

    Out: locus, set_id and source of the representative, members, sources, scope, difference, evidence (the best state of each
    kind), fit, risks (cleaned), interpretation, and columns to `keep` of the representative. A set without structure stands
    for itself.
    """
    alone = F.when((F.size("cds") == 0) & (F.size("introns") == 0) & (F.size("exons") == 0), F.col("set_id"))
    ranked = sets.withColumns({"__r": F.struct(source_rank(F.col("source"), order), F.col("set_id")), "__alone": alone})
    best = []
    for field in rules.EVIDENCE:
        states = F.array(*map(F.lit, rules.STATES[field]))
        at = F.array_position(states, F.col(f"evidence.{field}"))
        best.append(F.min(F.when(at > 0, at).otherwise(len(rules.STATES[field]) + 1)).alias(f"__{field}"))
    g = ranked.groupBy("locus", "cds", "introns", "__alone").agg(
        F.min_by(F.struct("set_id", "source", "fit", *keep), "__r").alias("r"), F.array_sort(F.collect_list("set_id")).alias("members"), F.array_sort(F.collect_set("source")).alias("sources"),
        _alike(F.struct("exons", "span")).alias("alike"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("set_id", "risks"))), lambda x: F.coalesce(x["risks"], F.array().cast(rules.NO_TAGS)))).alias("all_risks"), *best,
    )
    state = lambda f: F.get(F.array(*map(F.lit, rules.STATES[f])), F.col(f"__{f}") - 1).alias(f)
    one = F.size("members") == 1
    made = g.select(
        "locus", "r.set_id", "r.source", "r.fit", "members", "sources", "cds", "introns", *[f"r.{c}" for c in keep],
        F.when(one, "single_set").when(F.col("alike"), "CDS_intron_exon_identical").otherwise("CDS_intron_identical_UTR_or_span_differs").alias("scope"),
        F.when(~one & ~F.col("alike"), "UTR_or_transcript_span").otherwise("none").alias("difference"),
        F.struct(*[state(f) for f in rules.EVIDENCE]).alias("evidence"), rules.cleaned_tags(F.col("all_risks")).alias("risks"),
    )
    return made.withColumn("interpretation", rules.interpretation(F.col("evidence"), F.col("fit"), collapsed=True))


def component_fit(mapping: DataFrame, components: DataFrame) -> DataFrame:
    """Per set (locus, set_id): strong components covered and missing, uncertain and unsupported ones included, fused, fit.

    `mapping`: locus, set_id, component, state ("not_included" where it has none); `components`: locus, component, role, tier.
    """
    strong = F.col("role").isin("shared_core_component", "strong_component")
    uncertain = F.col("role") == "uncertain_extra_component"
    weak = F.col("tier").isin("low", "unsupported_or_not_assessed") & ~strong & ~uncertain
    covered = F.col("state") != "not_included"
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("component"))))
    # A strong component that a set's mapping doesn't name is not missing: only listed ones are judged, as covered or not.
    every = mapping.select("locus", "set_id").distinct().join(components, "locus").join(mapping, ["locus", "set_id", "component"], "left").withColumn("state", F.coalesce("state", F.lit("not_included")))
    g = every.groupBy("locus", "set_id").agg(
        ids(strong & covered).alias("strong_covered"), ids(strong & ~covered).alias("strong_missing"), ids(uncertain & covered).alias("uncertain_included"), ids(weak & covered).alias("unsupported_included"),
        F.bool_or(F.col("state") == "covered_within_same_gene").alias("fused"),
    )
    return g.withColumn("fit", rules.fit_label(*[F.col(c) for c in ("strong_missing", "uncertain_included", "unsupported_included", "fused")]))


def component_states(mapping: DataFrame, members: DataFrame) -> DataFrame:
    """Per locus, collapsed set and component: the state over the set's members (locus, set_id, member), and whether the states
    of the locus differ (`variable`)."""
    named = mapping.groupBy("locus", "component").agg(F.lit(1).alias("__x")).drop("__x")
    every = members.join(named, "locus").join(mapping.withColumnRenamed("set_id", "member"), ["locus", "member", "component"], "left")
    present = F.array_sort(F.collect_set(F.when(F.coalesce("state", F.lit("not_included")) != "not_included", F.col("state"))))
    g = every.groupBy("locus", "set_id", "component").agg(present.alias("p"))
    only = F.get("p", F.lit(0))
    word = (
        F.when(F.size("p") == 0, "absent").when(F.size("p") > 1, "mixed").when(only == "covered_within_same_gene", "present_as_fused_component").when(only == "covered_as_independent_gene", "present_as_independent_gene")
        .when(only == "covered_as_extra_mono_exon_gene", "present_as_uncertain_extra").otherwise("present")
    )
    made = g.select("locus", "set_id", "component", word.alias("state"))
    by = W.partitionBy("locus", "component")
    return made.withColumn("variable", F.min("state").over(by) != F.max("state").over(by))


def structure_differences(sets: DataFrame, variable: DataFrame | None = None) -> DataFrame:
    """Per locus: state of coding parts, introns and exons over its sets, of gene and transcript counts, overall, relevance.

    `sets`: locus, set_id, cds, introns, exons (arrays with one array of blocks per model), gene_count, transcript_count;
    `variable`: loci with components that sets have in different states.
    """
    inner = lambda c: F.transform(c, lambda m: F.when(F.size(m) > 2, F.slice(m, F.lit(2), F.greatest(F.size(m) - 2, F.lit(0)))).otherwise(F.slice(m, 1, 0)))
    g = sets.groupBy("locus").agg(
        F.count("*").alias("sets"), *[_alike(c).alias(f"__{c}") for c in ("cds", "introns", "exons")], *[_alike(inner(F.col(c))).alias(f"__{c}_in") for c in ("cds", "exons")],
        _alike("gene_count").alias("__genes"), _alike("transcript_count").alias("__tx"),
    )
    whole = lambda c: F.coalesce(c, F.lit(True))
    state = lambda c: F.when(whole(f"__{c}"), "identical").when(F.col(f"__{c}_in"), "terminal_only_difference").otherwise("different")
    same = lambda c: F.when(whole(c), "same").otherwise("different")
    out = g.select("locus", "sets", state("cds").alias("cds"), F.when(whole("__introns"), "identical").otherwise("different").alias("intron_chain"), state("exons").alias("exon_structure"), same("__genes").alias("gene_count"), same("__tx").alias("transcript_count"))
    out = out.withColumn("variable", F.lit(False)) if variable is None else out.join(variable.select("locus").distinct().withColumn("variable", F.lit(True)), "locus", "left").withColumn("variable", F.coalesce("variable", F.lit(False)))
    overall, relevance = rules.structure_overall(F.col("sets"), F.col("variable"), F.col("gene_count"), F.col("intron_chain"), F.col("cds"), F.col("exon_structure"))
    return out.withColumns({"overall": overall, "relevance": relevance})


def evidence_differences(sets: DataFrame) -> DataFrame:
    """Per locus: kinds of evidence that all its sets share (as kind=state), and those in which they differ."""
    value = lambda f: F.nullif(F.col(f"evidence.{f}"), F.lit(""))
    g = sets.groupBy("locus").agg(*[_alike(value(f)).alias(f"one_{f}") for f in rules.EVIDENCE], *[F.min(value(f)).alias(f"v_{f}") for f in rules.EVIDENCE])
    listed = lambda c, v: F.array_compact(F.array(*[F.when(c(F.col(f"one_{f}")), v(f)) for f in rules.EVIDENCE]))
    return g.select("locus", listed(lambda one: one, lambda f: F.concat(F.lit(f"{f}="), F.col(f"v_{f}"))).alias("shared"), listed(lambda one: ~one, F.lit).alias("differing"))


def comparison(sets: DataFrame) -> DataFrame:
    """Per locus: discriminator status, main conflict, default and recommended set, from sets (locus, set_id, interpretation,
    priority, split_merge)."""
    q = sets.withColumn("q", rules.set_quality(F.col("interpretation"), F.col("priority")))
    g = q.groupBy("locus").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("q")).alias("q"), "set_id")).alias("b"), F.collect_list("q").alias("all"), F.bool_or("split_merge").alias("split"))
    best = -F.col("b.q")
    stuck = (best <= 1) & F.col("split") & (F.col("n") > 1)
    first = F.size(F.filter("all", lambda x: x == best))
    status = F.when(stuck, "conflicting").when(F.col("n") == 1, "none").when((first == 1) & (best >= 3), "clear").otherwise("weak")
    return g.select(
        "locus", status.alias("discriminator_status"), F.when(F.col("split"), "split_merge").otherwise("none").alias("main_conflict"),
        F.when(stuck, "risk_if_unresolved_conflict").otherwise("select_best_listed_set").alias("recommended_default"), F.col("b.set_id").alias("recommended_set_id"),
    )


def auto_gates(sets: DataFrame, differences: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Per locus that a gate decides: gate, selected set, confidence, risk level and reasons, dominant and all sources.

    `sets` are collapsed (locus, set_id, sources, evidence, fit, topology_claim, interpretation, risks); `differences` per locus:
    overall, intron_chain, gene_count, transcript_count, variable, differing, main_conflict, possible_split_merge. A: one set is
    left. C: sets differ at their ends only and look alike in all else; the one of the first source stays. B: one set has more
    than half of three or more sources, full support and no rival.
    """
    e = F.col("evidence")
    strong = (e["short_read_junction"] == "full") | (e["long_read"] == "exact")
    fine = (F.col("fit") == "covers_core_components") & (F.col("interpretation") == "biologically_supported") & (e["coding_qc"] == "pass") & strong
    seen = F.struct("fit", "topology_claim", "interpretation", "evidence", F.array_sort("risks").alias("risks"))
    rank = F.struct(F.coalesce(F.array_min(F.transform("sources", lambda s: source_rank(s, order))), F.lit(len(order))).alias("k"), "set_id")
    row = F.struct("set_id", "interpretation", "risks", F.size("sources").alias("n_sources"))
    every = F.array_distinct(F.flatten(F.collect_list("sources")))
    g = sets.groupBy("locus").agg(F.count("*").alias("n"), F.first(row).alias("any"), F.min_by(row, rank).alias("first"), _alike(seen).alias("alike"), F.size(every).alias("all_sources"), F.collect_list(F.struct(fine.alias("fine"), rules.strong_risk(F.col("risks")).alias("risky"), row.alias("row"))).alias("rows"))
    d = g.join(differences, "locus", "left")
    able = F.filter("rows", lambda x: x["fine"] & ~x["risky"] & (2 * x["row"]["n_sources"] > F.col("all_sources")))
    alike = (F.col("overall") == "terminal_boundary_only") & (F.col("intron_chain") == "identical") & (F.col("gene_count") == "same") & (F.col("transcript_count") == "same") & ~F.col("variable") & (F.size("differing") == 0) & F.col("alike")
    calm = (F.coalesce("main_conflict", F.lit("none")) == "none") & ~F.coalesce("possible_split_merge", F.lit(False))
    dominant = calm & (F.col("all_sources") >= 3) & (F.size(able) == 1) & (F.size(F.filter("rows", lambda x: x["fine"])) == 1)
    gate = F.when(F.col("n") == 1, "Gate_A_single_set_after_CDS_intron_collapse").when(alike, "Gate_C_terminal_boundary_equivalent").when(dominant, "Gate_B_dominant_supported_set")
    chosen = F.when(F.col("n") == 1, F.col("any")).when(alike, F.col("first")).when(dominant, F.get(able, F.lit(0))["row"])
    made = d.select("locus", gate.alias("gate"), chosen.alias("c"), "all_sources").filter("gate is not null")
    level, reasons = rules.auto_risk(F.col("c.interpretation"), F.col("c.risks"), F.col("gate"))
    made = made.withColumns({"risk_level": level, "risk_reasons": reasons})
    confidence = F.when(F.col("gate").startswith("Gate_B"), "high").when(F.col("gate").startswith("Gate_C"), "medium").when(F.col("risk_level") == "low", "high").when(F.col("risk_level").isin("low_to_moderate", "moderate"), "medium").otherwise("low")
    return made.select("locus", "gate", F.col("c.set_id").alias("set_id"), confidence.alias("confidence"), "risk_level", "risk_reasons", F.when(F.col("gate").startswith("Gate_B"), F.col("c.n_sources")).alias("dominant_sources"), F.when(F.col("gate").startswith("Gate_B"), F.col("all_sources")).alias("all_sources"))


def long_read_sets(models: DataFrame, genes: DataFrame) -> DataFrame:
    """Long reads of a set: from the rows of its genes, or, where no gene has one, from its models.

    `models`: locus, source, gene_id, status, support, conflicts, risks (array); `genes`: source, gene_id, level, exact, partial,
    unsupported, conflicts, best (array), risks (array). Out, per locus and source: status, gene_rows, exact, partial,
    unsupported, mono, conflicts, best, risks.
    """
    is_ = lambda *s: F.count_if(F.col("support").isin(*s))
    lists = lambda c: F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(rules.NO_TAGS)))))
    m = models.groupBy("locus", "source").agg(
        F.bool_and(F.col("status") == "not_configured").alias("off"), F.bool_and(F.col("status") == "not_available_for_source").alias("away"), F.bool_or(F.col("status") == "available").alias("some"),
        is_("exact_chain_supported", "single_read_exact_chain").alias("m_exact"), is_("all_junctions_supported_no_exact_chain", "partial_junction_supported").alias("m_partial"), is_("unsupported_by_long_reads").alias("m_unsupported"),
        is_("mono_exon_not_assessable").alias("m_mono"), F.sum("conflicts").alias("m_conflicts"), lists(F.col("risks")).alias("m_risks"),
    )
    own = models.filter("gene_id <> ''").select("locus", "source", "gene_id").distinct().join(genes, ["source", "gene_id"]).groupBy("locus", "source").agg(
        F.count("*").alias("gene_rows"), *[F.sum(c).alias(f"g_{c}") for c in ("exact", "partial", "unsupported", "conflicts")], F.count_if(F.col("level") == "mono_exon_not_assessable").alias("g_mono"), lists(F.col("best")).alias("best"), lists(F.col("risks")).alias("g_risks"),
    )
    both = m.join(own, ["locus", "source"], "left").withColumn("gene_rows", F.coalesce("gene_rows", F.lit(0)))
    pick = lambda c: F.coalesce(F.when(F.col("gene_rows") > 0, F.col(f"g_{c}")).otherwise(F.col(f"m_{c}")), F.lit(0)).cast("long")
    live = ~F.col("off") & ~F.col("away")
    zero = lambda c: F.when(live, c).otherwise(F.lit(0)).cast("long")
    risks = F.transform(F.when(F.col("gene_rows") > 0, F.col("g_risks")).otherwise(F.col("m_risks")), lambda t: F.concat(F.lit("long_read_"), t))
    none = F.array().cast(rules.NO_TAGS)
    return both.select(
        "locus", "source", F.when(F.col("off"), "not_configured").when(F.col("away"), "not_available_for_source").when((F.col("gene_rows") > 0) | F.col("some"), "available").otherwise("missing_for_set").alias("status"),
        zero(F.col("gene_rows")).alias("gene_rows"), *[zero(pick(c)).alias(c) for c in ("exact", "partial", "unsupported")], zero(F.col("m_mono") + F.coalesce("g_mono", F.lit(0))).alias("mono"), zero(pick("conflicts")).alias("conflicts"),
        F.when(live, F.slice(F.array_sort(F.coalesce("best", none)), 1, 20)).otherwise(none).alias("best"),
        F.when(F.col("off"), none).when(F.col("away"), F.array(F.lit("long_read_not_available_for_source"))).otherwise(F.array_sort(risks)).alias("risks"),
    )


def component_layers(models: DataFrame) -> DataFrame:
    """Per locus and component: the sets and models that have it, its tier, type, claim, role and uncertainty.

    `models`: locus, set_id, component, introns (their number), tier; the best tier of a component's models counts.
    """
    tiers = ("high", "moderate", "low", "unsupported_or_not_assessed")
    at = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    g = models.groupBy("locus", "component").agg(F.count_distinct("set_id").alias("sets"), F.count("*").alias("models"), F.bool_and(F.col("introns") == 0).alias("mono"), F.min(F.when(at > 0, at).otherwise(len(tiers))).alias("k"))
    total = models.groupBy("locus").agg(F.count_distinct("set_id").alias("all_sets"))
    made = g.join(total, "locus").withColumn("tier", F.get(F.array(*map(F.lit, tiers)), F.col("k").cast("int") - 1))
    words = rules.component_words(F.col("mono"), F.col("sets"), F.col("all_sets"), F.col("tier"))
    return made.select("locus", "component", "sets", "all_sets", "models", "tier", *[v.alias(k) for k, v in words.items()])
