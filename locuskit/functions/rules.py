"""Rule ladders: each is one CASE expression over columns; words and limits are fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TAGS = "array<string>"


def tags(*pairs: tuple[Column, str | Column]) -> Column:
    """Sorted distinct tags whose conditions hold."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs]))))


def joined(array: Column, by: str = ",") -> Column:
    return F.array_join(array, by)


def compatible(a: Column, b: Column) -> Column:
    """Strands agree, or one of them is unknown."""
    return (a == b) | (a == ".") | (b == ".") | (a == "") | (b == "")


def junction_status(introns: Column, exact: Column, conflicting: Column) -> Column:
    return (
        F.when(introns == 0, "not_assessable").when(conflicting > 0, "conflicting_junction").when(exact == introns, "full_junction_support")
        .when(exact > 0, "partial_junction_support").otherwise("none_observed")
    )


def model_evidence(status: Column, introns: Column, nearby: Column, proteins: Column, coding: Column, exons: Column, source: Column) -> tuple[Column, Column, Column]:
    """(flags, risk tags, role) of a model."""
    unknown = ~status.isin("full_junction_support", "partial_junction_support", "conflicting_junction", "none_observed")
    flags = tags((status == "full_junction_support", "all_introns_junction_supported"), (status == "partial_junction_support", "partial_introns_junction_supported"), (proteins > 0, "protein_overlap_present"), (coding > 0, "CDS_present"))
    risks = tags(
        (status == "conflicting_junction", "conflicting_RNA_junction"), (status == "none_observed", "RNA_junction_none_observed_not_negative_evidence"),
        (unknown & (introns > 0), "RNA_junction_not_assessable"), (unknown & (introns == 0), "single_exon_model_no_splice_junction_to_assess"),
        (nearby > 0, "nearby_alternative_junctions"), (proteins == 0, "protein_evidence_none_observed"), (coding == 0, "no_CDS_features"), (exons == 0, "no_exon_features"),
    )
    role = F.when(source == "current", "base_model_candidate").when(status.isin("full_junction_support", "partial_junction_support") | (proteins > 0), "supported_alternative_candidate").otherwise("available_candidate_needs_validation")
    return flags, risks, role


def complexity(models: Column, structures: Column, genes_per_source: Column, span: Column, current: Column, tools: Column, most=(12, 8, 6, 500_000)) -> tuple[Column, Column]:
    """(class, reasons) of a locus; `most`: models, structures, genes of one source, positions."""
    hard = span > most[3]
    soft = [(models > most[0], "many_candidate_models_AI_arbitrable"), (structures > most[1], "many_unique_structures_AI_arbitrable"), (genes_per_source > most[2], "multi_gene_source_set_arbitration"), ((current > 1) & (tools > 1) & (genes_per_source > 1), "multi_current_multi_tool_gene_set_arbitration")]
    reasons = tags((hard, "locus_span_too_large"), *soft)
    return F.when(hard, "complex_risk_flagged").when(F.size(reasons) > 0, "ai_arbitrable_complex").otherwise("auto_arbitration_eligible"), reasons


def window_risks(span: Column, current_genes: Column, models: Column, sources: Column, only_weak_edges: Column, soft: int = 50_000, hard: int = 100_000, genes: int = 3, per_source: int = 3) -> Column:
    long = span > soft
    return tags(
        (span > hard, "window_span_above_hard_limit_for_AI"), (long & (current_genes > genes), "long_window_too_many_current_genes_for_AI"),
        (long & (models > sources * per_source), "long_window_too_many_candidate_models_for_AI"), (long & only_weak_edges, "long_window_weak_bridge_only_for_AI"),
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score(n: dict[str, Column], active: frozenset[str] = frozenset({"short_read", "long_read", "protein"})) -> dict[str, Column]:
    """The five channels, the penalty, the raw and the run-level score of a set of models, from its counts.

    Counts: models, pass, fail, warning, full, partial, none, junction_unknown, conflict, exact, long_partial, mono, unsupported,
    long_conflict, protein, risks; conditions: long_known, coding_present, all_junctions, full_chain. Fixed weights 25, 25, 15, 20, 10.
    """
    m = F.greatest(n["models"], F.lit(1))
    share = lambda x: x / m
    coding = F.when(n["fail"] > 0, F.greatest(F.lit(0.0), F.lit(8.0) - 8.0 * share(n["fail"]))).when(share(n["pass"]) >= 0.95, 25.0).when(share(n["pass"]) >= 0.6, 17.0).when(n["pass"] > 0, 8.0).otherwise(0.0)
    both = n["full"] + n["partial"]
    short = F.when(share(n["full"]) >= 0.95, 25.0).when(share(both) >= 0.8, 18.0).when(both > 0, 9.0).when((n["junction_unknown"] > 0) & (n["none"] == 0), 5.0).otherwise(0.0)
    known = n["exact"] + n["long_partial"]
    long = F.when(~n["long_known"], 0.0).when(share(n["exact"]) >= 0.8, 15.0).when(n["exact"] > 0, 10.0).when(share(known) >= 0.8, 10.0).when(n["long_partial"] > 0, 5.0).when((n["mono"] > 0) & (n["unsupported"] == 0), 3.0).otherwise(0.0)
    protein = F.when(share(n["protein"]) >= 0.8, 20.0).when(n["protein"] > 0, 10.0).otherwise(0.0) if "protein" in active else F.lit(0.0)
    structure = F.least(F.lit(10.0), F.when(n["coding_present"], 4.0).otherwise(0.0) + F.when(n["all_junctions"], 4.0).otherwise(0.0) + F.when(n["full_chain"], 2.0).otherwise(0.0))
    penalty = -(
        F.when(n["fail"] > 0, F.least(F.lit(25.0), 12.0 + 5.0 * n["fail"])).otherwise(0.0) + F.least(F.lit(8.0), 3.0 * n["warning"]) + F.least(F.lit(15.0), 5.0 * n["conflict"])
        + F.when(n["long_conflict"] > 0, 5.0).otherwise(0.0) + F.least(F.lit(10.0), 2.0 * n["risks"])
    )
    parts = {"coding": (coding, 25), "short_read": (short, 25), "long_read": (long, 15), "protein": (protein, 20), "structure": (structure, 10)}
    total = sum((p for p, _ in parts.values()), F.lit(0.0))
    used = [v for k, v in parts.items() if k in active or k in ("coding", "structure")]
    run = sum((p for p, _ in used), F.lit(0.0)) * 95.0 / float(sum(w for _, w in used))
    return {k: p for k, (p, _) in parts.items()} | {"penalty": penalty, "raw": clamp(total + penalty, 0.0, 100.0), "run_level": clamp(run + penalty, 0.0, 100.0)}


def tier(x: Column) -> Column:
    return F.when(x >= 75, "high").when(x >= 50, "moderate").when(x > 0, "low").otherwise("unsupported_or_not_assessed")


def evidence_level(fail: Column, status: Column, exact: Column, proteins: Column) -> Column:
    return F.when(fail, "poor").when((status == "full_junction_support") | exact, "strong").when((status == "partial_junction_support") | (proteins > 0), "moderate").otherwise("weak")


def route(current: Column, tools: Column) -> Column:
    return (
        F.when((tools > 0) & (current == 0), "tool_only_novel_gene_candidate").when((current > 0) & (tools == 0), "current_only_retain_no_deletion")
        .when((current > 0) & (tools > 0), "mixed_current_tool_arbitration").otherwise("no_selectable_annotation_model")
    )


def final_call(decision: Column, valid: Column, selected: Column, traced: Column, is_current: Column, novel: Column, unsupported: Column) -> dict[str, Column]:
    """final_call, call_group, relation_to_current, export_readiness; `decision` is null where there is none."""
    risk = decision == "risk_flagged"
    nothing = F.coalesce(selected, F.lit("")) == ""
    bad = ~valid | ~decision.isin("select_annotation_set", "risk_flagged")
    pick = lambda *v: (
        F.when(decision.isNull(), v[0]).when(bad, v[1]).when(nothing & risk, v[2]).when(nothing, v[3]).when(~traced, v[4]).when(novel, v[5])
        .when(is_current & risk, v[6]).when(is_current & unsupported, v[7]).when(is_current, v[8]).when(unsupported, v[9]).when(risk, v[10]).otherwise(v[11])
    )
    review, pending, blocked = "manual_review_required_before_export", "annotation_set_change_pending_validation", "blocked_or_review"
    return {
        "final_call": pick(
            "missing_decision", "invalid_decision_blocked", "risk_flagged_or_blocked", "invalid_selected_set_blocked", "invalid_selected_set_blocked", "novel_gene_candidate_manual_review",
            "keep_current_flagged", "keep_current_flagged", "keep_current", "annotation_set_selected_needs_manual_review", "annotation_set_selected_needs_manual_review", "annotation_set_selected_pending_validation",
        ),
        "call_group": pick("blocked", "blocked", "human_review_or_blocked", "blocked", "blocked", pending, "keep_current", "keep_current", "keep_current", pending, pending, pending),
        "relation_to_current": pick(
            "unknown", "unknown", "unresolved_annotation_set_conflict", "unknown", "unknown", "novel_gene_candidate_no_current_overlap", "current_set", "current_set", "current_set",
            "candidate_set_selected_but_unsupported_locus", "candidate_set_selected_with_risk_flag", "candidate_set_selected",
        ),
        "export_readiness": pick(blocked, blocked, blocked, blocked, blocked, review, review, "no_change", "no_change", review, review, "pending_validation_before_export"),
    }


def proposal_action(call: Column, models: Column, all_current: Column, replaced: Column) -> Column:
    return (
        F.when(call.isin("keep_current", "keep_current_flagged"), "keep_current").when(call.startswith("delete"), "keep_current_deletion_not_applied").when((models > 0) & all_current, "keep_current")
        .when(models == 0, "keep_current_no_selected_model").when(replaced > 0, "replace_current_with_selected_set").otherwise("add_novel_selected_set")
    )


def relation(action: Column, current: Column, proposed: Column) -> Column:
    return (
        F.when(action == "add_novel_selected_set", "novel_gene").when(action != "replace_current_with_selected_set", "other_proposal").when((current == 1) & (proposed == 1), "one_to_one_replacement")
        .when((current == 1) & (proposed > 1), "split_replacement").when((current > 1) & (proposed == 1), "merge_replacement").otherwise("complex_replacement")
    )


#: The policies for proposals that no current gene covers.
POLICIES = ("supported_novel_only", "supported_novel_plus_risk_replacement", "supported_novel_multitool_only", "supported_novel_singletool_junction_supported", "strict_supported_novel_multitool_only", "strict_supported_novel_singletool_junction_supported")


def policy(name: str, readiness: Column, call: Column, relation_: Column, supported: Column, sources: Column, junction: Column, uncovered: Column, exact_sources: Column) -> tuple[Column, Column]:
    """(include, reason) of a gene block under a policy."""
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name}")
    novel = call == "novel_gene_candidate_manual_review"
    rule: list[tuple[Column, bool, str]] = []
    if name.startswith("strict_"):
        rule += [(uncovered & ~supported, False, "strict_drop_novel_not_strong_moderate_or_unsupported"), (uncovered & (exact_sources >= 2), True, "strict_keep_supported_exact_cds_multitool_novel")]
        if name.endswith("junction_supported"):
            rule += [(uncovered & junction, True, "strict_keep_supported_singletool_junction_novel"), (uncovered, False, "strict_drop_supported_singletool_no_full_or_partial_junction")]
        else:
            rule.append((uncovered, False, "strict_drop_supported_singletool_or_unknown_novel"))
    rule += [(readiness == "", True, "keep_current_or_base_backbone"), (readiness == "pending_validation_before_export", True, "keep_pending_validation_replacement"), (novel & ~supported, False, "drop_novel_not_strong_moderate_or_unsupported")]
    if name in ("supported_novel_only", "supported_novel_plus_risk_replacement"):
        rule.append((novel, True, "keep_supported_novel"))
    elif not name.startswith("strict_"):
        rule.append((novel & (sources >= 2), True, "keep_supported_multitool_novel"))
        if name == "supported_novel_multitool_only":
            rule.append((novel, False, "drop_supported_singletool_or_unknown_novel"))
        else:
            rule += [(novel & junction, True, "keep_supported_singletool_junction_novel"), (novel, False, "drop_supported_singletool_no_full_or_partial_junction")]
    if name == "supported_novel_plus_risk_replacement":
        rule.append((relation_ == "candidate_set_selected_with_risk_flag", True, "keep_risk_flagged_replacement"))
    include, reason = F.lit(False), F.lit("drop_manual_review_or_blocked_proposal")
    for condition, keep, why in reversed(rule):
        include, reason = F.when(condition, F.lit(keep)).otherwise(include), F.when(condition, F.lit(why)).otherwise(reason)
    return include, reason


def review_bucket(flagged: Column, blocked: Column, readiness: Column, call: Column, group: Column, risks: Column, reasons: Column, source: Column, relation_: Column, confidence: Column, validate: Column) -> dict[str, Column]:
    """Bucket, rank and reasons of a review."""
    must = F.array_compact(F.array(
        F.when(flagged, "manual_review_router_flag"), F.when(blocked, "blocking_reasons_present"),
        F.when(readiness.isin("blocked", "manual_review", "manual_review_required", "not_ready", "not_exportable"), F.concat(F.lit("export_readiness="), readiness)),
        F.when(call.contains("blocked") | group.contains("blocked"), "blocked_final_call"),
    ))
    should = F.array_compact(F.array(
        F.when(risks, "risk_tags_present"), F.when(reasons, "reason_tags_present"), F.when((source != "") & (source != "current"), "selected_non_current_source"),
        F.when((relation_ != "") & ~relation_.isin("current_set", "no_change", "keep_current"), F.concat(F.lit("relation_to_current="), relation_)), F.when(confidence == "low", "low_confidence"),
    ))
    maybe = validate | (confidence == "medium")
    pick = lambda a, b, c, d: F.when(F.size(must) > 0, a).when(F.size(should) > 0, b).when(maybe, c).otherwise(d)
    return {
        "bucket": pick(F.lit("manual_required"), F.lit("review_recommended"), F.lit("optional_review"), F.lit("auto_accept")), "rank": pick(F.lit(0), F.lit(1), F.lit(2), F.lit(3)),
        "reasons": pick(joined(must, ";"), joined(should, ";"), F.lit("requires_validation_or_medium_confidence"), F.lit("low_review_priority")),
    }


def change_class(relations: Column, action: Column, call: Column, fallback: Column) -> Column:
    return (
        F.when(relations != "", relations).when(action == "add_novel_selected_set", "novel_gene").when(action == "replace_current_with_selected_set", "replacement_without_final_gene_mapping")
        .when(action != "", action).when(call.startswith("keep_current"), "keep_current").otherwise(F.coalesce(F.nullif(fallback, F.lit("")), F.nullif(call, F.lit("")), F.lit("unknown")))
    )


#: What a change of a locus means, in the words of its summary.
WITHOUT_CURRENT = ("no_current_arbitration_selection", "No base/current GFF was used; final IDs trace selected source models but do not replace current IDs.")
CHANGES = {
    "keep_current": "Current gene model is retained.",
    "one_to_one_replacement": "One current gene is replaced by one proposal gene; current gene ID may be reused according to policy.",
    "split_replacement": "One current gene is split into multiple final proposal genes.",
    "merge_replacement": "Multiple current genes are merged into one final proposal gene.",
    "complex_replacement": "Many-to-many or complex current/proposal replacement.",
    "novel_gene": "Selected proposal is a novel/tool-only gene candidate with no current gene replacement.",
}
OTHER_CHANGE = "See mapping/proposal records for detailed provenance."


def change_meaning(change: Column) -> Column:
    """The sentence of a change class."""
    words = F.create_map(*[F.lit(x) for k, v in (*CHANGES.items(), WITHOUT_CURRENT) for x in (k, v)])
    return F.coalesce(F.try_element_at(words, change), F.lit(OTHER_CHANGE))


def support_profile(n: dict[str, Column], active: frozenset[str] = frozenset({"short_read", "long_read", "protein"}), shared: Column | None = None, flags: Column | None = None) -> dict[str, Column]:
    """The words of a set's support, from the counts that `score` takes; `long_status` replaces `long_known` if it is given.

    `shared` says whether other sets have one of its structures, `flags` are the risk flags of its score.
    """
    m = F.greatest(n["models"], F.lit(1))
    share = lambda x: x / m
    both, known = n["full"] + n["partial"], n["exact"] + n["long_partial"]
    short = (
        F.when(n["conflict"] > 0, "conflicting_support").when(share(n["full"]) >= 0.95, "full_support").when(share(both) >= 0.8, "mostly_supported").when(both > 0, "partial_support")
        .when((n["junction_unknown"] > 0) & (n["none"] == 0), "not_assessable").when(n["none"] > 0, "none_observed").otherwise("not_configured")
    )
    status = n.get("long_status", F.when(n["long_known"], "available").otherwise("not_configured")) if "long_known" in n else n["long_status"]
    long = (
        F.when(status != "available", status).when(n["long_conflict"] > 0, "conflicting_chains_present").when(share(n["exact"]) >= 0.8, "exact_chain_support").when(share(known) >= 0.8, "mostly_supported")
        .when(known > 0, "partial_support").when((n["mono"] > 0) & (n["unsupported"] == 0), "not_assessable_mono_exon").when(n["unsupported"] > 0, "unsupported").otherwise("available_no_support")
    )
    protein = F.when(share(n["protein"]) >= 0.8, "supported").when(n["protein"] > 0, "partially_supported").otherwise("not_observed")
    off = F.lit("not_configured")
    shared = F.lit(False) if shared is None else shared
    return {
        "coding_qc": F.when(n["fail"] > 0, "fail").when(n["warning"] > 0, "warning").when(share(n["pass"]) >= 0.95, "pass").when(n["pass"] > 0, "partial_pass").otherwise("not_assessed"),
        "short_read_junction_support": short if "short_read" in active else off, "long_read_transcriptome_support": long if "long_read" in active else off, "protein_support": protein if "protein" in active else off,
        "candidate_generation_agreement": F.when(shared, "present").otherwise("not_detected"), "cross_candidate_consistency": F.when(shared, "candidate_generation_agreement_only").otherwise("not_detected"),
        "risk_level": F.lit("low") if flags is None else risk_level(flags),
    }


#: Parts of flags that make a risk high or moderate; parts of tags that say nothing against a set; tags that do.
HIGH_RISKS, MODERATE_RISKS = ("validation_fail", "conflicting_short_read_junction", "long_read_conflicting", "homolog_protein_not_observed"), ("warning", "partial", "limited", "not_assessed", "not_configured")
SILENT = (
    "not_observed", "none_observed", "not_assessable", "not_configured", "not_computed", "support_absent", "no_exact_chain", "missing_junction_support", "unsupported_by_long_reads", "unsupported_transcripts_present",
    "no_splice_junction_to_assess", "mono_exon_no_chain", "partial_junction_supported", "partial_junction_support", "partial_short_read_junction_support", "limited_short_read_junction_support",
    "model_level_no_junction_support", "missing_for_current", "long_read_none", "long_read_not_available", "single_read_exact",
)
STRONG_RISKS = ("conflicting_RNA_junction", "conflicting_short_read_junction", "possible_fusion_if_components_are_independent", "misses_core_component", "includes_unsupported_component")
EVIDENCE = ("coding_qc", "short_read_junction", "long_read", "protein")
#: The states of each kind of evidence, best first.
STATES = {
    "coding_qc": ("pass", "partial_pass", "warning", "not_assessed", "fail"), "short_read_junction": ("full", "partial", "conflict", "not_assessable", "not_observed", "not_configured"),
    "long_read": ("exact", "partial", "conflict", "not_assessable", "not_observed", "not_available", "not_configured"), "protein": ("supported", "partial", "not_observed", "not_configured"),
}


def _holds(array: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.coalesce(array, F.array().cast(NO_TAGS)), lambda x: F.coalesce(x.rlike("|".join(parts)), F.lit(False)))


def risk_level(flags: Column) -> Column:
    return F.when(_holds(flags, HIGH_RISKS), "high").when(_holds(flags, MODERATE_RISKS), "low_to_moderate").otherwise("low")


def cleaned_tags(array: Column, limit: int = 8) -> Column:
    """The first distinct tags that aren't empty and say something against a set."""
    kept = F.filter(F.coalesce(array, F.array().cast(NO_TAGS)), lambda x: F.coalesce(x != "", F.lit(False)) & ~F.lower(x).rlike("|".join(SILENT)))
    return F.slice(F.array_distinct(kept), 1, limit)


def set_states(n: dict[str, Column], active: frozenset[str] = frozenset({"short_read", "long_read", "protein"})) -> dict[str, Column]:
    """The state of each kind of evidence of a set: any model that has it counts. Counts as for `score`, and not_assessed."""
    short = (
        F.when(n["full"] > 0, "full").when(n["partial"] > 0, "partial").when(n["conflict"] > 0, "conflict").when((n["junction_unknown"] > 0) & (n["none"] == 0), "not_assessable")
        .when(n["none"] > 0, "not_observed").otherwise("not_configured")
    )
    long = (
        F.when(~n["long_known"], "not_available").when(n["exact"] > 0, "exact").when(n["long_partial"] > 0, "partial").when(n["long_conflict"] > 0, "conflict")
        .when((n["mono"] > 0) & (n["unsupported"] == 0), "not_assessable").otherwise("not_observed")
    )
    protein = F.when(n["protein"] >= F.greatest(n["models"], F.lit(1)), "supported").when(n["protein"] > 0, "partial").otherwise("not_observed")
    coding = F.when(n["fail"] > 0, "fail").when(n["warning"] > 0, "warning").when((n["pass"] > 0) & (n["not_assessed"] == 0), "pass").when(n["pass"] > 0, "partial_pass").otherwise("not_assessed")
    off = F.lit("not_configured")
    return {"coding_qc": coding, "short_read_junction": short if "short_read" in active else off, "long_read": long if "long_read" in active else off, "protein": protein if "protein" in active else off}


def interpretation(e: Column, fit: Column, collapsed: bool) -> Column:
    """What a set is, from its evidence struct (EVIDENCE) and component fit. A conflict weighs more than support in a set as it
    came, and less in one that stands for several `collapsed` ones."""
    bad = F.when(e["coding_qc"] == "fail", "biologically_problematic").when(fit.isin("misses_core_component", "includes_unsupported_component"), "topology_risk")
    support = e["short_read_junction"].isin("full", "partial") | e["long_read"].isin("exact", "partial") | e["protein"].isin("supported", "partial")
    conflict = (e["short_read_junction"] == "conflict") | (e["long_read"] == "conflict")
    steps = [(support, "biologically_supported"), (conflict, "evidence_conflict")]
    for condition, word in steps if collapsed else steps[::-1]:
        bad = bad.when(condition, word)
    return bad.otherwise("plausible_low_evidence")


def component_words(mono: Column, members: Column, total: Column, tier_: Column) -> dict[str, Column]:
    """Type, claim, role and uncertainty of a component, from whether all its models lack introns, the sets that have it, all sets."""
    kind = F.when(mono & (members < total), "possible_extra_or_mono_exon_component").when(mono, "mono_exon_protein_coding_component").otherwise("protein_coding_transcript_component")
    extra, shared = mono & (members < total), members == total
    return {
        "component_type": kind,
        "claim": F.when(extra, "possible extra mono-exon gene or candidate-specific coding unit").when(shared, "shared supported protein-coding transcript component").when(members > 1, "supported coding component shared by a subset of candidate sets").otherwise("candidate-specific protein-coding component"),
        "role": F.when(extra, "uncertain_extra_component").when(shared, "shared_core_component").when(tier_ == "high", "strong_component").otherwise("candidate_specific_component"),
        "uncertainty": F.when(extra, "mono_exon_or_extra_gene_status").when(shared, "terminal_boundary_or_transcript_span").otherwise("split_merge_or_component_presence"),
    }


def fit_label(missing: Column, uncertain: Column, unsupported: Column, fused: Column) -> Column:
    """How a set fits the components; the arguments are arrays of components, and whether any is covered within one gene."""
    return (
        F.when(F.size(missing) > 0, "misses_core_component").when(F.size(uncertain) > 0, "includes_uncertain_extra_component").when(F.size(unsupported) > 0, "includes_unsupported_component")
        .when(fused, "fusion_of_components").otherwise("covers_core_components")
    )


def topology_risks(claim: Column, fused: Column, missing: Column, uncertain: Column, risks: Column) -> dict[str, Column]:
    may = lambda c: F.when(c, "possible").otherwise("none")
    has = lambda tag: F.coalesce(F.array_contains(risks, tag), F.lit(False))
    return {
        "fusion_risk": may(fused | has("possible_fusion_if_components_are_independent")), "split_risk": may(claim.contains("independent_genes") | has("possible_over_split_if_transcriptional_bridge_supports_fusion")),
        "extra_gene_risk": may((F.size(uncertain) > 0) | has("may_accept_uncertain_extra_gene")), "missing_component_risk": may(F.size(missing) > 0),
    }


def direct_support(splice: Column, long: Column, protein: Column) -> Column:
    return F.when(splice & long, "splice_and_long_read").when(splice, "splice").when(long, "long_read").when(protein, "protein_only").otherwise("none")


#: Labels of direct support in the order in which the greatest is taken; of equal rank the first by name.
DIRECT = ("splice_and_long_read", "long_read", "splice", "protein_only", "none")


def component_priority(coding_fail: Column, missing: Column, extra: Column, extra_support: Column, split_possible: Column, split_support: Column) -> tuple[Column, Column]:
    """(priority, reasons) of a set by what its components lack."""
    weak = lambda label: label.isin("none", "protein_only")
    reasons = tags((coding_fail, "coding_qc_fail"), (missing > 0, "missing_strong_component"), ((extra > 0) & weak(extra_support), "unsupported_extra_component"), (split_possible & weak(split_support), "unsupported_split_or_fusion_topology"))
    first = [("coding_qc_fail", "low_priority_coding_problem"), ("missing_strong_component", "low_priority_missing_strong_component"), ("unsupported_extra_component", "low_priority_extra_component"), ("unsupported_split_or_fusion_topology", "low_priority_unsupported_split_or_fusion")]
    return F.coalesce(*[F.when(F.array_contains(reasons, r), F.lit(p)) for r, p in first], F.lit("normal")), reasons


def set_quality(interpretation_: Column, priority: Column) -> Column:
    rank = F.when(interpretation_ == "biologically_supported", 4).when(interpretation_ == "evidence_conflict", 2).when(interpretation_ == "plausible_low_evidence", 1).otherwise(0)
    return F.when(priority.startswith("low_priority"), F.least(rank, F.lit(1))).otherwise(rank)


def structure_overall(sets: Column, variable: Column, genes: Column, introns: Column, cds: Column, exons: Column) -> tuple[Column, Column]:
    """(overall, relevance) of the differences between a locus's sets, from their states."""
    topology, inner = variable | (genes == "different"), (cds == "different") | (exons == "different")
    terminal = (cds == "terminal_only_difference") | (exons == "terminal_only_difference")
    pick = lambda *v: F.when(sets <= 1, v[0]).when(topology, v[1]).when(introns == "different", v[2]).when(inner, v[3]).when(terminal, v[4]).otherwise(v[5])
    overall = pick("single_set", "split_merge_or_gene_count_difference", "intron_chain_difference", "internal_exon_or_CDS_difference", "terminal_boundary_only", "no_visible_structure_difference_after_collapse")
    return overall, pick("low", "high", "high", "medium", "low", "low")


def difference_class(sets: Column, split_merge: Column, variable: Column, overall: Column, evidence_differs: Column) -> Column:
    return (
        F.when(sets <= 1, "single_set").when(split_merge | (overall == "split_merge_or_gene_count_difference"), "split_merge_or_component_topology").when(variable, "component_presence_difference")
        .when(overall.isin("intron_chain_difference", "internal_exon_or_CDS_difference", "terminal_boundary_only"), overall).when(evidence_differs, "evidence_difference_between_structures")
        .otherwise("CDS_or_intron_structure_difference_without_visible_evidence_discriminator")
    )


def decision_focus(overall: Column, fields: Column) -> Column:
    """What a decision turns on, with the kinds of evidence that differ; a single set has none."""
    more = F.when(F.size(fields) > 0, F.concat(F.lit(" Evidence differs in: "), F.array_join(F.array_sort(F.array_distinct(fields)), ", "), F.lit("."))).otherwise("")
    text = (
        F.when(overall == "split_merge_or_gene_count_difference", "Compare component topology: independent genes versus fused, extra, or missing components.")
        .when(overall == "intron_chain_difference", "Compare alternative intron chains using transcript junction and long-read chain evidence.")
        .when(overall == "internal_exon_or_CDS_difference", "Compare internal CDS/exon structure using coding QC, transcript support, and protein support.")
        .when(overall == "terminal_boundary_only", "Candidate sets mainly differ at terminal CDS/exon boundaries; listed evidence may not distinguish them.")
    )
    rest = F.when(overall == "single_set", "Only one annotation set remains after deterministic collapse.").otherwise("Select the listed annotation set best supported by coding QC, transcript evidence, protein evidence, and component topology.")
    return F.coalesce(F.concat(text, more), rest)


def main_question(overall: Column, uncertainty: Column) -> Column:
    return (
        F.when(overall == "split_merge_or_gene_count_difference", "component_topology_or_gene_count").when(overall == "intron_chain_difference", "which_intron_chain_is_best_supported")
        .when(overall == "internal_exon_or_CDS_difference", "which_internal_CDS_or_exon_structure_is_best_supported").when(overall == "terminal_boundary_only", "terminal_boundary_tie_break")
        .otherwise(F.coalesce(uncertainty, F.lit("which listed annotation set is best supported")))
    )


def strong_risk(risks: Column) -> Column:
    return F.arrays_overlap(F.coalesce(risks, F.array().cast(NO_TAGS)), F.array(*map(F.lit, STRONG_RISKS)))


def auto_risk(interpretation_: Column, risks: Column, gate: Column) -> tuple[Column, Column]:
    """(level, reasons) of a set that a gate chose."""
    strong, some = strong_risk(risks), F.size(F.coalesce(risks, F.array().cast(NO_TAGS))) > 0
    base = F.when(interpretation_ == "biologically_supported", "low").when(interpretation_.isin("plausible_low_evidence", "evidence_conflict"), "moderate").otherwise("high")
    level = F.when(strong, "high").when(some & (base == "low"), "low_to_moderate").otherwise(base)
    reasons = tags(
        (interpretation_ == "biologically_supported", "selected_set_has_direct_biological_support"), (interpretation_ == "plausible_low_evidence", "single_selected_set_has_limited_direct_evidence"), (interpretation_ == "evidence_conflict", "selected_set_has_conflicting_evidence"),
        (~interpretation_.isin("biologically_supported", "plausible_low_evidence", "evidence_conflict"), "selected_set_has_topology_or_coding_risk"), (strong, "strong_risk_tag_present"), (~strong & some, "nonblocking_risk_tags_present"),
        (gate.startswith("Gate_A"), "no_alternative_CDS_intron_set_after_collapse"), (gate.startswith("Gate_B"), "dominant_supported_set_passed_strict_gate"), (gate.startswith("Gate_C"), "terminal_boundary_only_without_visible_evidence_discriminator"),
    )
    return level, reasons


def risk_router(complex_reasons: Column, hard: Column, supported_structures: Column, disjoint: Column, any_fail: Column, de_novo: bool = False) -> dict[str, Column]:
    """Whether a locus needs a decision, and which. `complex_reasons` and `hard` are arrays of triggers; `supported_structures` is
    the number of distinct structures of supported models; `disjoint`: junctions and proteins support different ones."""
    extra = tags((supported_structures > 1, "multiple_supported_distinct_structures"), (disjoint, "RNA_protein_support_different_structures"), (any_fail, "one_or_more_candidate_validation_fail"))
    triggers = F.array_sort(F.array_distinct(F.concat(complex_reasons, extra)))
    conflict = F.when(disjoint, "RNA_protein_conflict").when(supported_structures > 1, "supported_model_conflict").when(F.size(complex_reasons) > 0, "complex_locus").when(any_fail, "validation_conflict").otherwise("none")
    risk, flagged = F.size(hard) > 0, F.size(triggers) > 0
    pick = lambda a, b, c: F.when(risk, a).when(flagged, b).otherwise(c)
    space = "choose_candidate_set" if de_novo else "keep_current_set,choose_candidate_set"
    return {
        "risk_flagged": risk, "risk_triggers": F.when(risk, joined(F.array_sort(F.array_distinct(hard)))).otherwise(joined(triggers)), "decision_required": ~risk,
        "decision_requirement": pick("risk_flagged_no_ai_decision", "AI_must_select_best_candidate_gene_set_with_complexity_or_conflict_flags" if de_novo else "AI_must_select_best_gene_set_with_complexity_or_conflict_flags", "AI_must_select_one_best_candidate_gene_set_id" if de_novo else "AI_must_select_one_best_gene_set_id"),
        "recommended_action_space": pick("risk_flagged", space, space), "conflict_class": conflict,
        "recommended_next_gate": pick("risk_review_after_pipeline", "AI_gene_set_arbitration_with_complexity_flags_then_set_validation", "AI_gene_set_arbitration_then_set_validation"),
    }


def long_read_flags(status: Column, support: Column, more: Column) -> tuple[Column, Column]:
    """(flags, risk tags) that a model's long reads add; `more` are risk tags of the support table."""
    there = ~status.isin("not_configured", "not_available_for_source", "missing_for_model")
    is_ = lambda s: there & (support == s)
    flags = tags((is_("exact_chain_supported"), "long_read_exact_chain_supported"), (is_("single_read_exact_chain"), "long_read_single_read_exact_chain"), (is_("all_junctions_supported_no_exact_chain"), "long_read_all_junctions_supported_no_exact_chain"), (is_("partial_junction_supported"), "long_read_partial_junction_supported"))
    risks = tags(
        (status == "not_available_for_source", "long_read_not_available_for_source"), (status == "missing_for_model", "long_read_missing_for_model"), (is_("single_read_exact_chain"), "long_read_single_read_exact_chain"), (is_("all_junctions_supported_no_exact_chain"), "long_read_no_exact_chain"),
        (is_("partial_junction_supported"), "long_read_partial_junction_supported"), (is_("unsupported_by_long_reads"), "long_read_unsupported_by_long_reads"), (is_("mono_exon_not_assessable"), "long_read_mono_exon_not_assessable"),
    )
    own = F.transform(F.coalesce(more, F.array().cast(NO_TAGS)), lambda t: F.concat(F.lit("long_read_"), t))
    return flags, F.when(there, F.array_sort(F.array_union(risks, own))).otherwise(risks)


def junction_summary_flags(status: Column, fraction: Column, full_chain: Column) -> tuple[Column, Column]:
    """(flags, risk tags) that a current model's own junction summary adds."""
    direct = status == "direct_current_summary_available"
    some = direct & ~full_chain & (fraction > 0) & (fraction < 1)
    flags = tags((direct & full_chain, "model_level_full_intron_chain_supported"), (some, "model_level_partial_junction_support"))
    risks = tags((direct & ~full_chain & (fraction == 0), "model_level_no_junction_support"), (some, "model_level_partial_junction_support"), (status.isin("missing_for_current_model", "not_available_for_de_novo_model"), status))
    return flags, risks


def exclusion(fatal: Column, validation: Column, eligible: Column) -> Column:
    """Why a model takes no part in a decision; null if it does."""
    status = F.coalesce(F.nullif(fatal, F.lit("")), F.nullif(validation, F.lit("")), F.lit("not_assessed"))
    return F.when(status == "fail", "fatal_qc_fail").when(~F.coalesce(eligible, F.lit(False)), "pre_ai_eligibility_fail")


def supported_model(junctions: Column, validation: Column, proteins: Column) -> Column:
    return (validation != "fail") & (junctions.isin("full_junction_support", "partial_junction_support") | (proteins > 0))


def review_flags(call: Column, group: Column, decision: Column, readiness: Column, blocking: Column, novel: Column, deletion: Column, unsupported: Column) -> Column:
    return tags(
        (novel, "manual_review_novel_gene_candidate"), (deletion, "manual_review_deletion_candidate"), (unsupported, "manual_review_unsupported_locus"), (call.contains("manual_review") | group.contains("manual_review"), "manual_review_required"),
        ((call == "keep_current_flagged") | (decision == "risk_flagged"), "risk_flagged"), (group.contains("blocked") | blocking, "blocking_reason_present"),
        (readiness == "manual_review_required_before_export", "manual_review_required_before_export"), (call.startswith("delete") | deletion, "deletion_not_applied_by_proposal_exporter"),
    )


def model_order(validation: Column, junctions: Column, proteins: Column, source: Column, ident: Column) -> Column:
    """What models of a card sort by: coding, junctions, proteins, source rank, identifier."""
    at = lambda c, words, rest: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, words)), c), F.lit(0)) - 1, F.lit(rest))
    return F.struct(
        at(validation, ("pass", "warning", "not_assessed", "missing", "fail"), 5).alias("v"), at(junctions, ("full_junction_support", "partial_junction_support", "conflicting_junction", "none_observed", "not_assessable"), 5).alias("j"),
        F.when(proteins > 0, 0).otherwise(1).alias("p"), source.alias("s"), ident.alias("i"),
    )


def similarity(same_context: Column, left: Column, right: Column, same_structure: Column, introns_a: Column, introns_b: Column, splice: Column, coding: Column) -> Column:
    """Whether two models of a locus are one component: `left` and `right` are the shares of either span that both cover,
    `splice` and `coding` similarities of introns, and the greater one of exons and coding parts."""
    none = (F.size(introns_a) == 0) & (F.size(introns_b) == 0)
    both = lambda x: (left >= x) & (right >= x)
    return (
        F.when(~same_context, "different_context").when(~both(0.55), "separate_or_split_merge_component").when(same_structure, "exact_same_structure").when((F.size(introns_a) > 0) & (introns_a == introns_b), "same_intron_chain_boundary_variant")
        .when(none & both(0.70), "single_exon_overlap_component").when((splice >= 0.67) & both(0.65), "mostly_same_splice_component").when((coding >= 0.60) & both(0.70), "mostly_same_coding_component").otherwise("distinct_component_or_topology_conflict")
    )


def to_current(a: Column, b: Column) -> tuple[Column, Column]:
    """(tags, deltas) of a model against its closest current one; both are structs of start, end, blocks, gaps, coding.

    deltas: start, end, exons, introns, coding parts, coding length."""
    size, length = F.size, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"] + 1)
    same_gaps = a["gaps"] == b["gaps"]
    d0, d1 = a["start"] - b["start"], a["end"] - b["end"]
    contains, within = (d0 <= 0) & (d1 >= 0), (d0 >= 0) & (d1 <= 0)
    n, m = size(a["coding"]), size(b["coding"])
    same_coding = a["coding"] == b["coding"]
    found = tags(
        (a["blocks"] == b["blocks"], "same_exon_chain"), (same_gaps, "same_intron_chain"), (~same_gaps, "alternative_intron_chain"), (same_coding, "same_CDS_chain"), (~same_coding & (n == m), "CDS_boundary_difference"),
        (~same_coding & (n > m), "extra_CDS_blocks"), (~same_coding & (n < m), "fewer_CDS_blocks"), (same_gaps & ((d0 != 0) | (d1 != 0)), "terminal_boundary_difference_only"), (contains, "candidate_contains_current_span"), (~contains & within, "candidate_within_current_span"),
    )
    deltas = F.struct(d0.alias("start"), d1.alias("end"), (size(a["blocks"]) - size(b["blocks"])).alias("exons"), (size(a["gaps"]) - size(b["gaps"])).alias("introns"), (n - m).alias("coding_parts"), (length(a["coding"]) - length(b["coding"])).alias("coding_length"))
    return found, deltas


def unsupported_reasons(level: Column, sets: Column) -> Column:
    """Why a locus counts as unsupported; `sets` is an array of evidence structs. None from a moderate level on."""
    any_ = lambda f: F.exists(sets, f)
    made = tags(
        (F.lit(True), "no_listed_set_has_moderate_or_strong_biological_support"), (~any_(lambda e: e["short_read_junction"] == "full"), "no_full_short_read_junction_support"), (~any_(lambda e: e["long_read"] == "exact"), "no_exact_long_read_chain_support"),
        (~any_(lambda e: e["short_read_junction"].isin("full", "partial") | e["long_read"].isin("exact", "partial")), "no_transcript_structure_support"), (~any_(lambda e: e["protein"].isin("supported", "partial")), "no_homolog_protein_support"),
        (any_(lambda e: e["coding_qc"] == "fail"), "one_or_more_sets_fail_coding_qc"), (F.size(sets) == 0, "no_ai_visible_annotation_set"),
    )
    return F.when(level.isin("strong", "moderate"), F.array().cast(NO_TAGS)).otherwise(made)


def review_priority(route_: Column, level: Column, sets: Column) -> Column:
    return (
        F.when(route_ != "tool_only_novel_gene_candidate", "not_applicable").when((level == "strong") & (sets <= 1), "high").when(level == "strong", "high_after_arbitration")
        .when(level == "moderate", "medium").when(level == "weak", "low").otherwise("qc_review")
    )
