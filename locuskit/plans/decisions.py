"""Scores, gates, decisions, final calls, policies and reviews over cards made of orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import rules, text
from locuskit.operators import tables
from locuskit.plans.registry import query
from locuskit.plans.views import table
from locuskit.streaming.junctions import best_records

#: Counts of a set, from a line's keys: column, SQL.
_COUNTS = {
    "models": "1 + l_partkey % 5", "fail": "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END", "pass": "l_partkey % 5", "warning": "l_suppkey % 4", "full": "l_partkey % 3", "partial": "l_suppkey % 2",
    "none": "l_orderkey % 2", "junction_unknown": "l_linenumber % 3", "conflict": "CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 0 END", "exact": "l_suppkey % 3", "long_partial": "l_orderkey % 3", "mono": "l_partkey % 2",
    "unsupported": "l_linenumber % 2", "long_conflict": "l_suppkey % 5 // 4", "protein": "l_orderkey % 5", "risks": "l_linenumber % 7",
}


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by locus while rows are narrow: sets, and all that is grouped by locus after them, need no further shuffle.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition("l_orderkey")
    li = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.expr(e.replace("//", "DIV")).cast("long").alias(f"c_{n}") for n, e in _COUNTS.items()])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir)
    n = {k: F.col(f"c_{k}") for k in _COUNTS} | {"long_known": F.col("l_partkey") % 4 > 0, "coding_present": F.col("l_suppkey") % 6 > 0, "all_junctions": F.col("c_full") == 2, "full_chain": F.col("l_partkey") % 11 == 0}
    made = rules.score(n, frozenset({"short_read", "protein"}))
    return s.select(F.col("l_orderkey").alias("locus"), F.col("l_linenumber").alias("set_no"), *[v.alias(k) for k, v in made.items()]).withColumn("tier", rules.tier(F.col("raw")))


_SCORE = "WITH k AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL), n AS (SELECT *, " + ", ".join(f'{e} AS "c_{c}"' for c, e in _COUNTS.items()) + """ FROM k),
p AS (SELECT l_orderkey AS locus, l_linenumber AS set_no,
  CASE WHEN c_fail > 0 THEN greatest(0, 8 - 8 * c_fail / c_models) WHEN c_pass / c_models >= 0.95 THEN 25 WHEN c_pass / c_models >= 0.6 THEN 17 WHEN c_pass > 0 THEN 8 ELSE 0 END::DOUBLE AS coding,
  CASE WHEN c_full / c_models >= 0.95 THEN 25 WHEN (c_full + c_partial) / c_models >= 0.8 THEN 18 WHEN c_full + c_partial > 0 THEN 9 WHEN c_junction_unknown > 0 AND c_none = 0 THEN 5 ELSE 0 END::DOUBLE AS short_read,
  CASE WHEN l_partkey % 4 = 0 THEN 0 WHEN c_exact / c_models >= 0.8 THEN 15 WHEN c_exact > 0 THEN 10 WHEN (c_exact + c_long_partial) / c_models >= 0.8 THEN 10 WHEN c_long_partial > 0 THEN 5 WHEN c_mono > 0 AND c_unsupported = 0 THEN 3 ELSE 0 END::DOUBLE AS long_read,
  CASE WHEN c_protein / c_models >= 0.8 THEN 20 WHEN c_protein > 0 THEN 10 ELSE 0 END::DOUBLE AS protein,
  least(10, CASE WHEN l_suppkey % 6 > 0 THEN 4 ELSE 0 END + CASE WHEN c_full = 2 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 11 = 0 THEN 2 ELSE 0 END)::DOUBLE AS structure,
  -(CASE WHEN c_fail > 0 THEN least(25, 12 + 5 * c_fail) ELSE 0 END + least(8, 3 * c_warning) + least(15, 5 * c_conflict) + CASE WHEN c_long_conflict > 0 THEN 5 ELSE 0 END + least(10, 2 * c_risks))::DOUBLE AS penalty FROM n),
r AS (SELECT *, greatest(0, least(100, coding + short_read + long_read + protein + structure + penalty))::DOUBLE AS raw, greatest(0, least(100, (coding + short_read + protein + structure) * 95.0 / 80.0 + penalty))::DOUBLE AS run_level FROM p)
"""


@query(_SCORE + "SELECT *, CASE WHEN raw >= 75 THEN 'high' WHEN raw >= 50 THEN 'moderate' WHEN raw > 0 THEN 'low' ELSE 'unsupported_or_not_assessed' END AS tier FROM r", views=False)
def r11_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five channels, penalty, raw and run-level score where long reads are no active class."""
    return scored(spark, sf_dir)


@query(_SCORE + "SELECT locus, set_no, rank() OVER (PARTITION BY locus ORDER BY raw DESC) AS place FROM r", views=False)
def w01_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition rank: equal scores share a place."""
    return scored(spark, sf_dir).select("locus", "set_no", F.rank().over(W.partitionBy("locus").orderBy(F.desc("raw"))).cast("long").alias("place"))


@query("SELECT l_orderkey AS locus, array_to_string(list_sort(list_filter([CASE WHEN span > 100000 THEN 'window_span_above_hard_limit_for_AI' END, CASE WHEN span > 50000 AND genes > 3 THEN 'long_window_too_many_current_genes_for_AI' END, CASE WHEN span > 50000 AND models > sources * 3 THEN 'long_window_too_many_candidate_models_for_AI' END, CASE WHEN span > 50000 AND weak THEN 'long_window_weak_bridge_only_for_AI' END], lambda x: x IS NOT NULL)), ',') AS risks FROM (SELECT l_orderkey, sum(l_quantity * 700)::BIGINT AS span, count(DISTINCT l_partkey) AS genes, count(*) * 2 AS models, count(DISTINCT l_suppkey % 2) AS sources, bool_and(l_returnflag = 'N') AS weak FROM lineitem GROUP BY l_orderkey)", views=False)
def r09_window_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity") * 700).cast("long").alias("span"), F.count_distinct("l_partkey").alias("genes"), (F.count("*") * 2).alias("models"), F.count_distinct(F.col("l_suppkey") % 2).alias("sources"), F.bool_and(F.col("l_returnflag") == "N").alias("weak"),
    )
    return n.select(F.col("l_orderkey").alias("locus"), rules.joined(rules.window_risks(*[F.col(c) for c in ("span", "genes", "models", "sources", "weak")])).alias("risks"))


@query("SELECT l_orderkey AS locus, CASE WHEN t > 0 AND c = 0 THEN 'tool_only_novel_gene_candidate' WHEN c > 0 AND t = 0 THEN 'current_only_retain_no_deletion' WHEN c > 0 AND t > 0 THEN 'mixed_current_tool_arbitration' ELSE 'no_selectable_annotation_model' END AS route FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 5) AS c, count(*) FILTER (l_returnflag <> 'N' AND l_quantity > 5) AS t FROM lineitem GROUP BY l_orderkey)", views=False)
def r25_review_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("l_quantity") > 5
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(big & (F.col("l_returnflag") == "N")).alias("c"), F.count_if(big & (F.col("l_returnflag") != "N")).alias("t"))
    return n.select(F.col("l_orderkey").alias("locus"), rules.route(F.col("c"), F.col("t")).alias("route"))


#: A decision per order: none for some, invalid ones, both kinds, with and without selection.
_DECISION = """WITH d AS (SELECT o_orderkey AS card, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'risk_flagged' WHEN 2 THEN 'delete' ELSE 'select_annotation_set' END AS decision, o_orderkey % 11 > 0 AS valid,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'S01' END AS selected, o_orderkey % 13 > 0 AS traced, o_orderstatus = 'F' AS cur, o_orderkey % 6 = 0 AS novel, o_custkey % 4 = 0 AS unsupported FROM orders)
"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("card"), F.when(k % 7 == 0, None).when(k % 7 == 1, "risk_flagged").when(k % 7 == 2, "delete").otherwise("select_annotation_set").alias("decision"), (k % 11 > 0).alias("valid"),
        F.when(k % 5 == 0, "").otherwise("S01").alias("selected"), (k % 13 > 0).alias("traced"), (F.col("o_orderstatus") == "F").alias("cur"), (k % 6 == 0).alias("novel"), (F.col("o_custkey") % 4 == 0).alias("unsupported"),
    )


def final_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.final_call(*[F.col(c) for c in ("decision", "valid", "selected", "traced", "cur", "novel", "unsupported")])
    return _decisions(spark, sf_dir).select("card", *[v.alias(k) for k, v in made.items()])


_CALL = _DECISION + """, f AS (SELECT *, CASE WHEN decision IS NULL THEN 1 WHEN NOT valid OR decision = 'delete' THEN 2 WHEN selected = '' AND decision = 'risk_flagged' THEN 3 WHEN selected = '' OR NOT traced THEN 4 WHEN novel THEN 5
  WHEN cur AND (decision = 'risk_flagged' OR unsupported) THEN 6 WHEN cur THEN 7 WHEN unsupported THEN 8 WHEN decision = 'risk_flagged' THEN 9 ELSE 10 END AS k FROM d),
call AS (SELECT card, ['missing_decision', 'invalid_decision_blocked', 'risk_flagged_or_blocked', 'invalid_selected_set_blocked', 'novel_gene_candidate_manual_review', 'keep_current_flagged', 'keep_current', 'annotation_set_selected_needs_manual_review', 'annotation_set_selected_needs_manual_review', 'annotation_set_selected_pending_validation'][k] AS final_call,
  ['blocked', 'blocked', 'human_review_or_blocked', 'blocked', 'annotation_set_change_pending_validation', 'keep_current', 'keep_current', 'annotation_set_change_pending_validation', 'annotation_set_change_pending_validation', 'annotation_set_change_pending_validation'][k] AS call_group,
  ['unknown', 'unknown', 'unresolved_annotation_set_conflict', 'unknown', 'novel_gene_candidate_no_current_overlap', 'current_set', 'current_set', 'candidate_set_selected_but_unsupported_locus', 'candidate_set_selected_with_risk_flag', 'candidate_set_selected'][k] AS relation_to_current,
  CASE WHEN k <= 4 THEN 'blocked_or_review' WHEN k = 5 OR k IN (8, 9) OR (k = 6 AND decision = 'risk_flagged') THEN 'manual_review_required_before_export' WHEN k IN (6, 7) THEN 'no_change' ELSE 'pending_validation_before_export' END AS export_readiness FROM f)
"""


@query(_CALL + "SELECT * FROM call", views=False)
def r30_final_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_calls(spark, sf_dir)


@query(_CALL + "SELECT metric, value, n FROM (SELECT 'final_call' AS metric, final_call AS value, count(*) AS n FROM call GROUP BY final_call UNION ALL SELECT 'call_group', call_group, count(*) FROM call GROUP BY call_group UNION ALL SELECT 'export_readiness', export_readiness, count(*) FROM call GROUP BY export_readiness)", views=False)
def a18_call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of several columns in one pass, by unpivoting."""
    long = final_calls(spark, sf_dir).unpivot(["card"], ["final_call", "call_group", "export_readiness"], "metric", "value")
    return long.groupBy("metric", "value").agg(F.count("*").alias("n"))


@query(_CALL + "SELECT card, CASE WHEN final_call LIKE 'keep_current%' THEN 'keep_current' WHEN m > 0 AND alone THEN 'keep_current' WHEN m = 0 THEN 'keep_current_no_selected_model' WHEN r > 0 THEN 'replace_current_with_selected_set' ELSE 'add_novel_selected_set' END AS action FROM (SELECT *, card % 4 AS m, card % 9 = 0 AS alone, card % 3 AS r FROM call)", views=False)
def r31_proposal_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("card")
    return final_calls(spark, sf_dir).select("card", rules.proposal_action(F.col("final_call"), c % 4, c % 9 == 0, c % 3).alias("action"))


@query("SELECT o_orderkey AS locus, CASE WHEN a = 0 THEN 'novel_gene' WHEN a = 1 THEN 'other_proposal' WHEN c = 1 AND n = 1 THEN 'one_to_one_replacement' WHEN c = 1 AND n > 1 THEN 'split_replacement' WHEN c > 1 AND n = 1 THEN 'merge_replacement' ELSE 'complex_replacement' END AS relation FROM (SELECT o_orderkey, o_orderkey % 5 AS a, 1 + o_custkey % 2 AS c, 1 + o_custkey % 3 AS n FROM orders)", views=False)
def r33_locus_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("o_orderkey") % 5
    action = F.when(a == 0, "add_novel_selected_set").when(a == 1, "keep_current").otherwise("replace_current_with_selected_set")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("locus"), rules.relation(action, 1 + F.col("o_custkey") % 2, 1 + F.col("o_custkey") % 3).alias("relation"))


def _policy_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("card")
    return final_calls(spark, sf_dir).withColumns({"export_readiness": F.when(c % 8 == 0, "").otherwise(F.col("export_readiness")), "supported": c % 3 > 0, "sources": c % 4, "junction": c % 5 < 2, "uncovered": (F.col("final_call") == "novel_gene_candidate_manual_review") & (c % 8 > 0), "exact": c % 3})


_POLICY = _CALL + ", q AS (SELECT card, CASE WHEN card % 8 = 0 THEN '' ELSE export_readiness END AS ready, final_call = 'novel_gene_candidate_manual_review' AS novel, relation_to_current = 'candidate_set_selected_with_risk_flag' AS risk, card % 3 > 0 AS ok, card % 4 AS sources, card % 5 < 2 AS junction, final_call = 'novel_gene_candidate_manual_review' AND card % 8 > 0 AS uncovered, card % 3 AS exact FROM call)\n"


@query(_POLICY + """SELECT policy, card, CASE WHEN policy LIKE 'strict%' AND uncovered THEN ok AND (exact >= 2 OR (policy LIKE '%junction%' AND junction)) WHEN ready IN ('', 'pending_validation_before_export') THEN true
  WHEN novel THEN ok AND (policy IN ('supported_novel_only', 'supported_novel_plus_risk_replacement') OR (policy NOT LIKE 'strict%' AND sources >= 2) OR (policy = 'supported_novel_singletool_junction_supported' AND junction))
  ELSE policy = 'supported_novel_plus_risk_replacement' AND risk END AS include FROM q, (SELECT unnest(['supported_novel_only', 'supported_novel_plus_risk_replacement', 'supported_novel_multitool_only', 'supported_novel_singletool_junction_supported', 'strict_supported_novel_multitool_only', 'strict_supported_novel_singletool_junction_supported']) AS policy)""", views=False)
def f11_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's choice for each block."""
    cols = [F.col(c) for c in ("export_readiness", "final_call", "relation_to_current", "supported", "sources", "junction", "uncovered", "exact")]
    each = F.array(*[F.struct(F.lit(p).alias("policy"), rules.policy(p, *cols)[0].alias("include")) for p in rules.POLICIES])
    return _policy_inputs(spark, sf_dir).select("card", F.explode(each).alias("x")).select("x.policy", "card", "x.include")


@query("SELECT o_orderkey AS card, CASE WHEN must THEN 'manual_required' WHEN should THEN 'review_recommended' WHEN maybe THEN 'optional_review' ELSE 'auto_accept' END AS bucket, CASE WHEN must THEN 0 WHEN should THEN 1 WHEN maybe THEN 2 ELSE 3 END AS rank FROM (SELECT o_orderkey, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 17 = 0) AS must, o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR (o_orderstatus = 'O' AND o_custkey % 2 = 0) OR o_orderpriority LIKE '5%' AS should, o_orderpriority LIKE '3%' OR o_orderkey % 4 = 0 AS maybe FROM orders)", views=False)
def r35_review_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    confidence = F.when(F.col("o_orderpriority").startswith("5"), "low").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("high")
    made = rules.review_bucket(
        k % 11 == 0, k % 13 == 0, F.when(k % 17 == 0, "blocked").otherwise("ready"), F.lit("keep_current"), F.lit("keep_current"), c % 5 == 0, c % 7 == 0,
        F.when((F.col("o_orderstatus") == "O") & (c % 2 == 0), "ToolA").otherwise("current"), F.lit("current_set"), confidence, k % 4 == 0,
    )
    return table(spark, sf_dir, "orders").select(k.alias("card"), made["bucket"].alias("bucket"), made["rank"].alias("rank"))


@query("WITH a AS (SELECT o_orderkey AS card, o_orderpriority AS p FROM orders), b AS (SELECT l_orderkey AS card, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT event_id * 3 AS card, event_type AS t FROM events) SELECT coalesce(a.card, b.card, c.card) AS card, coalesce(p, t, 'none') AS chosen, coalesce(n, 0) AS n FROM a FULL JOIN b ON a.card = b.card FULL JOIN c ON c.card = coalesce(a.card, b.card)", views=False)
def j13_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three tables by card, the first source preferred."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("card"), F.col("o_orderpriority").alias("chosen"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("card"), F.col("event_type").alias("chosen"))
    return tables.preferred([a, b, c], "card").select("card", F.coalesce("chosen", F.lit("none")).alias("chosen"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT user_id AS card, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) = 1 AS fast, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 AS careful, count(DISTINCT event_type) AS n FROM events GROUP BY user_id", views=False)
def a19_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column group per profile, and the number of distinct answers."""
    e = table(spark, sf_dir, "events").withColumn("profile", F.when(F.col("event_type") == "click", "fast").when(F.col("event_type") == "view", "careful").otherwise("other"))
    wide = tables.agreement(e, ["user_id"], "profile", ["fast", "careful"], "event_type")
    return wide.select(F.col("user_id").alias("card"), (F.col("fast") > 0).alias("fast"), (F.col("careful") > 0).alias("careful"), "n")


@query("SELECT user_id AS card, max_by(event_id, {'ok': value > 50, 'i': event_id}) AS kept FROM events GROUP BY user_id", views=False)
def r29_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a card's records the last valid one, or the last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("card"), "event_id", "value")
    return best_records(e, "card", F.col("value") > 50, "event_id").select("card", F.col("event_id").alias("kept"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown_decision' END, CASE WHEN k IS NULL THEN 'missing_selection' END, CASE WHEN k % 10 = 3 THEN 'selection_not_listed' END, CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'risk_not_allowed' END], lambda x: x IS NOT NULL), ';') AS errors FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)", views=False)
def r28_decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract checks of decisions as a list of errors."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    checks = [
        (~F.col("event_type").isin("click", "view", "purchase"), "unknown_decision"), (F.col("k").isNull(), "missing_selection"), (F.col("k") % 10 == 3, "selection_not_listed"), ((F.col("event_type") == "view") & (F.col("k") % 2 == 0), "risk_not_allowed"),
    ]
    return e.select("event_id", tables.broken_rules(*checks).alias("errors"))


@query("SELECT l_orderkey AS locus, count(DISTINCT l_returnflag) > 1 AS flag_differs, count(DISTINCT l_linestatus) > 1 AS status_differs, count(DISTINCT l_quantity) > 1 AS quantity_differs, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'evidence' WHEN count(DISTINCT l_quantity) > 1 THEN 'structure' ELSE 'none' END AS focus FROM lineitem GROUP BY l_orderkey", views=False)
def a22_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields tell the sets of a locus apart, and what the decision turns on."""
    n = tables.differing(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"flag_differs": "l_returnflag", "status_differs": "l_linestatus", "quantity_differs": "l_quantity"})
    return n.select(F.col("l_orderkey").alias("locus"), "flag_differs", "status_differs", "quantity_differs", F.when(F.col("flag_differs"), "evidence").when(F.col("quantity_differs"), "structure").otherwise("none").alias("focus"))


@query("SELECT l_orderkey AS locus, CASE min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' WHEN 3 THEN 'N' END AS best FROM lineitem GROUP BY l_orderkey", views=False)
def a24_best_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of ordered states; unknown ones come last."""
    return tables.best_state(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ("R", "A", "N"), "best").select(F.col("l_orderkey").alias("locus"), "best")


@query("SELECT l_orderkey AS locus, CASE WHEN sets = 1 THEN 'A' WHEN sets > 1 AND NOT conflict AND sources >= 3 AND top * 2 > n THEN 'B' ELSE 'decide' END AS gate FROM (SELECT l_orderkey, count(*) AS sets, sum(c)::BIGINT AS n, max(c) AS top, bool_or(f) AS conflict, sum(c)::BIGINT AS sources FROM (SELECT l_orderkey, l_returnflag, count(*) AS c, bool_or(l_discount > 0.09) AS f FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)", views=False)
def r23_auto_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set left, or a strict majority of at least three members without conflict; else a decision is needed."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("c"), F.bool_or(F.col("l_discount") > 0.09).alias("f"))
    n = sets.groupBy("l_orderkey").agg(F.count("*").alias("sets"), F.sum("c").alias("n"), F.max("c").alias("top"), F.bool_or("f").alias("conflict"))
    gate = F.when(F.col("sets") == 1, "A").when(~F.col("conflict") & (F.col("n") >= 3) & (F.col("top") * 2 > F.col("n")), "B").otherwise("decide")
    return n.select(F.col("l_orderkey").alias("locus"), gate.alias("gate"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'poor' WHEN p_size < 20 THEN 'strong' WHEN p_size % 2 = 0 THEN 'moderate' ELSE 'weak' END AS level, 'T' || CASE WHEN p_size < 10 THEN lpad(p_size::VARCHAR, 2, '0') ELSE p_size::VARCHAR END AS label FROM part", views=False)
def x21_evidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    level = rules.evidence_level(s < 10, F.when(s < 20, "full_junction_support").otherwise("none_observed"), F.lit(False), (s + 1) % 2)
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("level"), text.numbered_id("T", s, 2).alias("label"))
