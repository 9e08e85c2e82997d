"""Summary rows, component differences, mapping order and manifest counters over projections of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.operators import identifier_summary, summaries
from locuskit.plans.registry import query
from locuskit.plans.views import table, transcripts


@query("SELECT l_orderkey AS card_id, n AS set_count, p AS component_count, f AS topology_class, (q > 100)::VARCHAR AS possible_split_merge, CASE WHEN o_orderstatus = 'F' THEN 'auto_select' ELSE 'send_to_ai' END AS routing_decision, CASE WHEN o_orderstatus = 'F' THEN left(o_orderpriority, 1) ELSE '' END AS auto_gate, CASE WHEN o_orderstatus = 'F' THEN 'S' || o_custkey ELSE '' END AS auto_selected_set_id, CASE WHEN o_orderstatus = 'F' THEN 'low' ELSE '' END AS auto_risk_level, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS review_router_class, CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice > 5000)::VARCHAR ELSE '' END AS manual_review FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS p, max(l_returnflag) AS f, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey", views=False)
def h24_card_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary row per card, with automatic decisions and review where there are any."""
    o = table(spark, sf_dir, "orders")
    cards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.count("*").alias("sets"), F.count_distinct("l_suppkey").alias("components"), F.max("l_returnflag").alias("topology_class"), (F.sum("l_quantity") > 100).alias("possible_split_merge"))
    auto = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("card_id"), F.left("o_orderpriority", F.lit(1)).alias("auto_gate"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("selected_set_id"), F.lit("low").alias("auto_risk_level"))
    review = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("card_id"), F.col("o_orderpriority").alias("router_class"), (F.col("o_totalprice") > 5000).alias("manual_review"))
    return summaries.card_summary(cards, auto, review)


@query("""SELECT event_id AS card_id, CASE WHEN event_id % 4 = 0 THEN 'ok' WHEN event_id % 4 = 1 THEN 'local_ok' ELSE 'error' END AS api_status, (event_id % 5 > 0 AND event_id % 4 < 2)::VARCHAR AS valid, CASE WHEN event_id % 5 = 0 THEN 'a;b' ELSE 'ok' END AS validation_errors, d AS decision, 'S' || user_id AS selected_set_id,
  CASE WHEN d = 'risk_flagged' THEN 'low' WHEN user_id % 3 = 0 THEN 'high' WHEN user_id % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence, CASE d WHEN 'select_annotation_set' THEN 'set:S' || user_id WHEN 'risk_flagged' THEN 'risk_flagged:set:S' || user_id ELSE 'invalid' END AS selected_key, event_type AS tags
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'select_annotation_set' WHEN 'view' THEN 'risk_flagged' ELSE '' END AS d FROM events)""", views=False)
def h25_decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions as rows of a table, with their confidence and what they select."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    return summaries.decision_summary(e.select(
        F.col("event_id").alias("card_id"), F.when(k == 0, "ok").when(k == 1, "local_ok").otherwise("error").alias("api_status"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("errors"),
        F.when(F.col("event_type") == "click", "select_annotation_set").when(F.col("event_type") == "view", "risk_flagged").alias("decision"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("selected_set_id"),
        F.array("event_type").alias("tags"), F.when(F.col("user_id") % 3 == 0, "clear").when(F.col("user_id") % 3 == 1, "weak").otherwise("none").alias("discriminator_status"),
    ))


@query("WITH s AS (SELECT DISTINCT l_orderkey AS locus, l_linenumber AS st, l_suppkey % 4 AS c, max(l_returnflag) AS state FROM lineitem GROUP BY ALL), e AS (SELECT a.locus, a.c, b.st, coalesce(s.state, 'absent') AS state FROM (SELECT DISTINCT locus, c FROM s) a JOIN (SELECT DISTINCT locus, st FROM s) b ON a.locus = b.locus LEFT JOIN s ON s.locus = a.locus AND s.c = a.c AND s.st = b.st) SELECT locus AS locus_id, 'c' || c AS component_id, string_agg('s' || st || '=' || state, ',' ORDER BY st) AS shown FROM e GROUP BY locus, c HAVING count(DISTINCT state) > 1", views=False)
def h18_component_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that the sets of a locus don't share in one state, with every set's state."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("locus_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("set_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 4).cast("string")).alias("component_id")).agg(F.max("l_returnflag").alias("state"))
    d = summaries.component_differences(s)
    entries = F.array_sort(F.transform(F.map_entries("values_by_set"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return d.select("locus_id", "component_id", F.array_join(entries, ",").alias("shown"))


@query("SELECT tx_id // 4 AS locus_id, count(*) FILTER (source = 'current') AS current_models, count(*) FILTER (source <> 'current') AS tool_models FROM tx GROUP BY ALL")
def h21_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and other models of a locus, over those that can be selected and those that can't."""
    t = transcripts(spark, sf_dir).select(F.floor(F.col("tx_id") / 4).alias("locus_id"), "source", "tx_id")
    return summaries.model_counts(t.filter("tx_id % 3 > 0"), t.filter("tx_id % 3 = 0"))


@query("SELECT tx_id, feature_type, mapping_role, row_number() OVER (PARTITION BY gene_id ORDER BY f, r, final_id, source_name, tx_id::VARCHAR) AS place FROM (SELECT tx_id, gene_id, source AS source_name, CASE WHEN n % 3 = 0 THEN 'gene' ELSE 'transcript' END AS feature_type, CASE WHEN n % 3 = 0 THEN 1 ELSE 2 END AS f, CASE n % 2 WHEN 0 THEN 'selected_origin' ELSE 'current_lineage' END AS mapping_role, CASE n % 2 WHEN 0 THEN 2 ELSE 1 END AS r, CASE WHEN n % 3 = 0 THEN gene_id ELSE 't' || tx_id END AS final_id FROM tx)")
def o11_mapping_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the rows of a public mapping within their gene."""
    n = F.size("blocks")
    t = transcripts(spark, sf_dir).select(
        "tx_id", F.when(n % 3 == 0, "gene").otherwise("transcript").alias("feature_type"), F.when(n % 2 == 0, "selected_origin").otherwise("current_lineage").alias("mapping_role"), F.when(n % 3 == 0, F.col("gene_id")).otherwise(F.concat(F.lit("t"), F.col("tx_id").cast("string"))).alias("final_id"),
        F.when(n % 3 > 0, F.col("gene_id")).otherwise("").alias("final_parent_id"), F.col("source").alias("source_name"), F.col("tx_id").cast("string").alias("source_id"),
    )
    return summaries.mapping_places(t).select("tx_id", "feature_type", "mapping_role", "place")


@query("SELECT '{\"mode\":\"SJ\",\"run\":\"x\",\"metrics\":{' || string_agg('\"' || metric || '\":' || n, ',' ORDER BY metric) || '}}' AS value FROM (SELECT 'orders:' || o_orderstatus AS metric, count(*) AS n FROM orders GROUP BY ALL)", views=False)
def k17_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and counters of a run as one JSON row."""
    metrics = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("orders:"), "o_orderstatus").alias("metric")).agg(F.count("*").alias("value"))
    return summaries.manifest({"run": "x", "mode": "SJ"}, metrics)


_CHANGED = """WITH call AS (SELECT 'L' || c_custkey AS locus, c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'keep_current' WHEN 1 THEN 'replace' WHEN 2 THEN 'keep_current_flagged' ELSE '' END AS final_call, CASE c_nationkey % 3 WHEN 0 THEN 'novel' WHEN 1 THEN '' ELSE 'same' END AS relation,
  CASE WHEN c_custkey % 3 = 0 THEN ['C:g9:t' || c_custkey] ELSE ['A:g' || c_nationkey || ':t1', 'B:g2', 'A:g' || c_nationkey || ':t1'] END AS ids, c_mktsegment AS seg, c_nationkey FROM customer),
o AS (SELECT 'L' || o_custkey AS locus, * FROM orders),
item AS (
  SELECT locus, 'current' AS f, 0 AS a, o_orderkey AS b, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['r' || o_orderkey % 3] ELSE ['c' || o_orderkey % 6, 'c' || o_orderkey % 5] END) AS v, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [0] ELSE [0, 1] END) AS c FROM o
  UNION ALL SELECT locus, 'actions', 0, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'keep_current' WHEN 'O' THEN 'add_novel_selected_set' ELSE '' END, 0 FROM o
  UNION ALL SELECT locus, 'pgenes', 1, o_orderkey, 'Proposal_' || o_orderkey % 7, 0 FROM o UNION ALL SELECT locus, 'pgenes', 0, o_orderkey, 'Proposal_g' || o_orderkey % 2, 0 FROM o WHERE o_orderkey % 5 = 0
  UNION ALL SELECT locus, 'flags', 0, o_orderkey, o_orderpriority, 0 FROM o UNION ALL SELECT locus, 'risks', 1, o_orderkey, left(o_orderpriority, 1), 0 FROM o UNION ALL SELECT locus, 'risks', 0, 0, seg, 0 FROM call
  UNION ALL SELECT locus, 'final', 0, o_orderkey, 'G' || o_orderkey % 8, 0 FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT locus, 'reuse', 0, o_orderkey, 'G' || o_orderkey % 8, 0 FROM o WHERE o_orderkey % 10 = 0
  UNION ALL SELECT locus, 'relations', 0, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'split_replacement' ELSE '' END, 0 FROM o WHERE o_orderkey % 5 = 0
  UNION ALL SELECT locus, 'tx', 0, o_orderkey, 'T' || o_orderkey % 9, 0 FROM o WHERE o_orderkey % 5 = 1
  UNION ALL SELECT locus, 'models', 0, 0, unnest(ids), unnest(range(len(ids))) FROM call
  UNION ALL SELECT locus, 'sources', 0, 0, CASE WHEN x LIKE 'A:%' AND c_custkey % 2 = 0 THEN 'toolA' ELSE split_part(x, ':', 1) END, c FROM (SELECT locus, c_custkey, unnest(ids) AS x, unnest(range(len(ids))) AS c FROM call)
  UNION ALL SELECT locus, 'genes', 0, 0, split_part(x, ':', 2), c FROM (SELECT locus, unnest(ids) AS x, unnest(range(len(ids))) AS c FROM call)),
firsts AS (SELECT locus, f, v, min({'a': a::BIGINT, 'b': b::BIGINT, 'c': c::BIGINT}) AS p FROM item WHERE v <> '' GROUP BY ALL), j AS (SELECT locus, f, string_agg(v, ';' ORDER BY p) AS s FROM firsts GROUP BY ALL),
w AS (SELECT locus, @ FROM j GROUP BY locus),
k AS (SELECT call.locus AS locus_id, CASE WHEN relations <> '' THEN relations WHEN actions = 'add_novel_selected_set' THEN 'novel_gene' WHEN actions <> '' THEN actions WHEN final_call LIKE 'keep_current%' THEN 'keep_current' WHEN relation <> '' THEN relation WHEN final_call <> '' THEN final_call ELSE 'unknown' END AS change_class, w.* EXCLUDE (locus) FROM call JOIN w ON w.locus = call.locus)
SELECT locus_id, change_class, current AS current_gene_ids, reuse AS reuse_current_gene_ids, CASE WHEN final = '' AND change_class = 'keep_current' THEN current ELSE final END AS final_gene_ids, tx AS final_transcript_ids, pgenes AS proposal_gene_ids, models AS selected_model_ids, sources AS source_sources, genes AS source_gene_ids,
  CASE change_class WHEN 'keep_current' THEN 'Current gene model is retained.' WHEN 'split_replacement' THEN 'One current gene is split into multiple final proposal genes.' WHEN 'novel_gene' THEN 'Selected proposal is a novel/tool-only gene candidate with no current gene replacement.' ELSE 'See mapping/proposal records for detailed provenance.' END AS replacement_interpretation,
  flags AS review_flags, risks AS risk_tags FROM k""".replace("@", ", ".join(f"coalesce(max(s) FILTER (f = '{x}'), '') AS {x}" for x in ("current", "actions", "pgenes", "flags", "risks", "final", "reuse", "relations", "tx", "models", "sources", "genes")))


@query(_CHANGED, views=False)
def j16_identifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each locus from its call, proposal records and both mappings."""
    s = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    c, o, n, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("c_custkey"), F.col("o_orderkey")
    calls = c.select(
        s("L", n).alias("locus_id"), F.when(n % 4 == 0, "keep_current").when(n % 4 == 1, "replace").when(n % 4 == 2, "keep_current_flagged").alias("final_call"), F.when(F.col("c_nationkey") % 3 == 0, "novel").when(F.col("c_nationkey") % 3 == 2, "same").otherwise("").alias("relation_to_current"),
        F.when(n % 3 > 0, s("A:g", F.col("c_nationkey"), ":t1, B:g2;A:g", F.col("c_nationkey"), ":t1")).alias("selected_real_model_ids"), s("C:g9:t", n).alias("selected_model_id"), F.col("c_mktsegment").alias("risk_tags"),
    )
    models = c.filter(n % 2 == 0).select(s("L", n).alias("locus_id"), s("A:g", F.col("c_nationkey"), ":t1").alias("model_id"), F.lit("toolA").alias("source"), F.lit("").alias("gene_id"))
    row = o.withColumns({"locus_id": s("L", F.col("o_custkey")), "row_idx": k})
    proposals = row.select(
        "locus_id", "row_idx", F.when(F.col("o_orderstatus") == "F", "keep_current").when(F.col("o_orderstatus") == "O", "add_novel_selected_set").alias("proposal_action"), F.when(k % 4 > 0, s("c", k % 6, ",c", k % 5)).alias("current_gene_ids"), s("r", k % 3).alias("removed_current_gene_ids"),
        s("V2PROP_", k % 7).alias("export_gene_id"), F.col("o_orderpriority").alias("review_flags"), F.left("o_orderpriority", F.lit(1)).alias("risk_tags"),
    )
    genes = row.filter(k % 5 == 0).select("locus_id", "row_idx", s("G", k % 8).alias("final_gene_id"), F.when(k % 2 == 0, "true").otherwise("false").alias("reuse_current_gene_id"), F.when(F.col("o_custkey") % 2 == 0, "split_replacement").otherwise("").alias("final_relation"), s("V2PROP_g", k % 2).alias("proposal_gene_id"))
    tx = row.filter(k % 5 == 1).select("locus_id", "row_idx", s("T", k % 9).alias("final_transcript_id"))
    got = identifier_summary.identifier_summary(calls, models, proposals, genes, tx)
    return got.select("locus_id", "change_class", "current_gene_ids", "reuse_current_gene_ids", "final_gene_ids", "final_transcript_ids", "proposal_gene_ids", "selected_model_ids", "source_sources", "source_gene_ids", "replacement_interpretation", "review_flags", "risk_tags")
