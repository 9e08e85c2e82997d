"""Summary rows of cards and decisions, differences by component, the order of a public mapping, reports and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.operators import tables

#: States of a decision that was made; order of features and roles in a mapping.
MADE = ("ok", "local_ok")
FEATURES, ROLES = ("gene", "transcript"), ("current_lineage", "selected_origin")


def source_priority(values: Sequence[str]) -> list[str]:
    """Sources from comma-separated values, each once; `current` leads where it isn't named."""
    order = list(dict.fromkeys(s for v in values or () for x in str(v).split(",") if (s := x.strip())))
    return order if "current" in order else ["current", *order]


def shown(c: Column) -> Column:
    """Text of a value, empty for null; truth in lower case."""
    return F.coalesce(c.cast("string"), F.lit(""))


def model_counts(models: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """For each locus_id the current and the other models, over those that can be selected and those that were excluded."""
    every = models.select("locus_id", "source").unionByName(excluded.select("locus_id", "source")) if excluded is not None else models
    is_current = F.coalesce(F.col("source") == "current", F.lit(False))
    return every.groupBy("locus_id").agg(F.count_if(is_current).alias("current_models"), F.count_if(~is_current).alias("tool_models"))


def card_summary(cards: DataFrame, auto: DataFrame, review: DataFrame) -> DataFrame:
    """One row per card (card_id, sets, components, topology columns) with what was decided without a question and where it is reviewed.

    `auto` has card_id, auto_gate, selected_set_id, auto_risk_level; `review` card_id, router_class and flags; one row a card each.
    A card without an automatic decision is sent on; missing text is empty.
    """
    a = auto.select("card_id", *[F.col(c).alias(f"a_{c}") for c in ("auto_gate", "selected_set_id", "auto_risk_level")], F.lit(True).alias("a"))
    r = review.select("card_id", *[F.col(c).alias(f"r_{c}") for c in review.columns if c != "card_id"])
    whole = cards.join(a, "card_id", "left").join(r, "card_id", "left")
    told = [c for c in cards.columns if c not in ("card_id", "sets", "components", "possible_split_merge")]
    return whole.select(
        "card_id", F.coalesce("sets", F.lit(0)).alias("set_count"), F.coalesce("components", F.lit(0)).alias("component_count"), *[shown(F.col(c)).alias(c) for c in told], F.coalesce("possible_split_merge", F.lit(False)).cast("string").alias("possible_split_merge"),
        F.when(F.col("a"), "auto_select").otherwise("send_to_ai").alias("routing_decision"), shown(F.col("a_auto_gate")).alias("auto_gate"), shown(F.col("a_selected_set_id")).alias("auto_selected_set_id"), shown(F.col("a_auto_risk_level")).alias("auto_risk_level"),
        *[shown(F.col(f"r_{c}")).alias(f"review_{c}" if c == "router_class" else c) for c in review.columns if c != "card_id"],
    )


def selected_key(decision: Column, set_id: Column) -> Column:
    """What a decision selects, as one text by which profiles are compared."""
    chosen = F.concat(F.lit("set:"), shown(set_id))
    return F.when(decision == "select_annotation_set", chosen).when(decision == "risk_flagged", F.concat(F.lit("risk_flagged:"), chosen)).otherwise("invalid")


def confidence(decision: Column, discriminator: Column) -> Column:
    """How sure a decision is by what tells the sets apart; flagged ones never are."""
    return F.when(decision == "risk_flagged", "low").when(discriminator == "clear", "high").when(discriminator == "weak", "medium").otherwise("low")


#: Words of a decision by rule.
UNSETTLED, FLAGGED, LISTED = "unresolved_mutually_exclusive_candidate_sets", "risk_flagged_by_card_comparison", "selected_listed_annotation_set"


def local_decisions(cards: DataFrame) -> DataFrame:
    """Decisions without a question to anyone, one a card: card_id, decision, selected_set_id, confidence, reason_tags, risk_tags,
    requires_validation.

    Cards have card_id, `sets` (array of set_id, interpretation, component_fit, risks, in their order) and their comparison:
    recommended_set_id, recommended_default, discriminator_status, main_conflict. A recommended set that the card doesn't list
    gives way to its first one; a card without sets selects none.
    """
    listed = F.filter("sets", lambda x: x["set_id"] == F.col("recommended_set_id"))
    chosen = cards.withColumn("__s", F.coalesce(F.get(listed, F.lit(0)), F.get("sets", F.lit(0))))
    is_ = lambda c, v: shown(F.col(c)) == v
    risky = is_("recommended_default", "risk_if_unresolved_conflict") & is_("discriminator_status", "conflicting") & ~is_("main_conflict", "none")
    decision = F.when(risky, "risk_flagged").otherwise("select_annotation_set")
    why = F.array(F.coalesce(F.nullif(F.col("__s.interpretation"), F.lit("")), F.lit(LISTED)), F.nullif(F.col("__s.component_fit"), F.lit("")))
    reasons = F.when(risky, F.array(F.lit(UNSETTLED))).otherwise(F.array_sort(F.array_distinct(F.array_compact(why))))
    risks = F.when(risky, F.array(F.lit(FLAGGED))).otherwise(F.coalesce("__s.risks", F.array().cast("array<string>")))
    return chosen.select("card_id", decision.alias("decision"), shown(F.col("__s.set_id")).alias("selected_set_id"), confidence(decision, F.col("discriminator_status")).alias("confidence"), reasons.alias("reason_tags"), risks.alias("risk_tags"), F.lit(True).alias("requires_validation"))


def decision_summary(records: DataFrame) -> DataFrame:
    """Rows of decisions (card_id, api_status, errors, decision, selected_set_id, tags, discriminator_status) as a table shows them."""
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    d, s = shown(F.col("decision")), shown(F.col("selected_set_id"))
    return records.select(
        "card_id", "api_status", ((F.size(errors) == 0) & F.col("api_status").isin(*MADE)).cast("string").alias("valid"), F.when(F.size(errors) == 0, "ok").otherwise(F.array_join(errors, ";")).alias("validation_errors"),
        d.alias("decision"), s.alias("selected_set_id"), confidence(d, F.col("discriminator_status")).alias("confidence"), selected_key(d, s).alias("selected_key"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";").alias("tags"),
    )


def component_differences(states: DataFrame) -> DataFrame:
    """For each locus_id the components that its sets don't all have in one state: component_id and `values`, an entry per set.

    `states` has locus_id, set_id, component_id, state. A set without a row for a component has it `absent`.
    """
    sets = states.select("locus_id", "set_id").distinct()
    every = states.select("locus_id", "component_id").distinct().join(sets, "locus_id").join(states, ["locus_id", "component_id", "set_id"], "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    held = F.array_sort(F.collect_list(F.struct("set_id", "state")))
    return every.groupBy("locus_id", "component_id").agg(held.alias("values"), F.count_distinct("state").alias("n")).filter("n > 1").select("locus_id", "component_id", F.map_from_entries("values").alias("values_by_set"))


def mapping_order(rows: DataFrame) -> list[Column]:
    """Order of a public mapping: by gene, genes before transcripts, lineage before origin, then by names."""
    return [F.coalesce(F.nullif("final_parent_id", F.lit("")), "final_id"), tables.rank_in(F.col("feature_type"), FEATURES), tables.rank_in(F.col("mapping_role"), ROLES), F.col("final_id"), F.col("source_name"), F.col("source_id")]


def mapping_places(rows: DataFrame, name: str = "place") -> DataFrame:
    """A mapping's rows numbered within their gene, in its order."""
    gene, *rest = mapping_order(rows)
    return rows.withColumn(name, F.row_number().over(W.partitionBy(gene).orderBy(*rest)).cast("long"))


def report(title: str, facts: dict[str, str], metrics: DataFrame, notes: Sequence[str] = ()) -> str:
    """A Markdown report from a table of metric and value, which has a row for each counter of a run (never of a record)."""
    lines = [f"# {title}", "", *[f"- {k}: `{v}`" for k, v in facts.items()], "", "## Summary", "", *[f"- {r.metric}: {r.value}" for r in metrics.orderBy("metric").collect()]]
    return "\n".join([*lines, *(["", "## Boundary", "", *[f"- {x}" for x in notes]] if notes else [])]) + "\n"


def manifest(facts: dict[str, str], metrics: DataFrame) -> DataFrame:
    """One row of JSON: the facts of a run, and its metrics as a map with sorted keys."""
    held = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.col("value").cast("long").alias("value"))))).alias("metrics"))
    return held.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(facts.items())], "metrics")).alias("value"))


def run_warnings(policy: str, policies: Sequence[str], mode: str, files: Sequence[tuple[str, str]]) -> list[str]:
    """What is doubtful about a run before it starts: its policy, its mode, and its annotation files (name, role)."""
    roles, out = [r for _, r in files], []
    if policy not in policies:
        out.append(f"invalid_policy_export_policy:{policy}")
    if len(files) < 2:
        out.append("too_few_gffs:provide at least two GFF files.")
    current, candidates = roles.count("current"), roles.count("candidate")
    if mode == "correction":
        if current != 1:
            out.append(f"invalid_current_gff_count:correction mode requires exactly one current/base GFF; found {current}.")
        if not candidates:
            out.append("too_few_candidate_gffs:correction mode requires at least one candidate GFF in addition to current/base.")
    else:
        if current:
            out.append("arbitration_mode_ignores_current_role:use correction mode if replacement mapping to current/base is required.")
        if candidates < 2:
            out.append("too_few_candidate_gffs:arbitration mode requires at least two candidate GFFs.")
    seen: set[str] = set()
    for name, _ in files:
        if name in seen:
            out.append(f"duplicate_gff_name:{name}")
        seen.add(name)
    return out
