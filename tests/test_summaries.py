"""Small pieces of summaries that no query shows."""

from pyspark.sql import functions as F

from locuskit.functions import rules
from locuskit.operators import summaries
from tests.test_operators import rows


def test_source_priority():
    assert summaries.source_priority(["a, b", "b,,c"]) == ["current", "a", "b", "c"]
    assert summaries.source_priority(["a,current"]) == ["a", "current"] and summaries.source_priority([]) == ["current"]


def test_report_and_manifest(spark):
    metrics = rows(spark, [("b", 2), ("a", 1)], "metric string, value int")
    assert summaries.report("Run", {"policy": "p"}, metrics, ["No truth."]) == "# Run\n\n- policy: `p`\n\n## Summary\n\n- a: 1\n- b: 2\n\n## Boundary\n\n- No truth.\n"
    assert summaries.manifest({"z": "1", "y": "2"}, metrics).first().value == '{"y":"2","z":"1","metrics":{"a":1,"b":2}}'


def test_warnings():
    ok = summaries.run_warnings("supported_novel_only", rules.POLICIES, "correction", [("c", "current"), ("a", "candidate")])
    assert ok == []
    bad = summaries.run_warnings("other", rules.POLICIES, "correction", [("a", "candidate"), ("a", "candidate")])
    assert [x.split(":")[0] for x in bad] == ["invalid_policy_export_policy", "invalid_current_gff_count", "duplicate_gff_name"]
    free = summaries.run_warnings("supported_novel_only", rules.POLICIES, "arbitration", [("c", "current")])
    assert [x.split(":")[0] for x in free] == ["too_few_gffs", "arbitration_mode_ignores_current_role", "too_few_candidate_gffs"]


def test_cards_without_anything(spark):
    cards = rows(spark, [(1, None, None, None, None)], "card_id int, sets long, components long, possible_split_merge boolean, main_conflict string")
    auto, review = rows(spark, [], "card_id int, auto_gate string, selected_set_id string, auto_risk_level string"), rows(spark, [], "card_id int, router_class string")
    assert summaries.card_summary(cards, auto, review).first().asDict() == {"card_id": 1, "set_count": 0, "component_count": 0, "main_conflict": "", "possible_split_merge": "false", "routing_decision": "send_to_ai", "auto_gate": "", "auto_selected_set_id": "", "auto_risk_level": "", "review_router_class": ""}
    d = rows(spark, [(1, "ok", None, None, None, None, None)], "card_id int, api_status string, errors array<string>, decision string, selected_set_id string, tags array<string>, discriminator_status string")
    x = summaries.decision_summary(d).first()
    assert (x.valid, x.validation_errors, x.confidence, x.selected_key) == ("true", "ok", "low", "invalid")
    assert summaries.model_counts(rows(spark, [("L", None), ("L", "current")], "locus_id string, source string")).first()[1:] == (1, 1)
    assert summaries.component_differences(d.select(F.lit("L").alias("locus_id"), F.lit("s").alias("set_id"), F.lit("c").alias("component_id"), F.lit("x").alias("state"))).count() == 0
