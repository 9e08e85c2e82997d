"""URL filtering by host rules and link-graph propagation.

Rules decide the pages they fit. For all others, trust flows from the hosts of allowed pages along links between hosts, and
distrust flows against the links from the hosts of blocked pages (who links to bad hosts is suspect), both as personalised
PageRank with the same damping. Both start from vectors that sum to 1, so neither side outweighs the other by the number of its
seeds, and what hosts without outgoing links hold goes back to the seeds, so both sums stay 1. A host whose distrust outweighs
its trust is blocked; a host without either is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import discard, stash, stash_at, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Rounds end when the scores of a kind move by less than this in all; by damping alone that takes about 90 rounds at most.
RESIDUAL, ROUNDS = 1e-6, 100
#: A host is blocked if distrust > THRESHOLD * trust. Sums differ in their last digits with the order of rows, so the lead must
#: be more than this share of it.
THRESHOLD, LEAD = 1.0, 1e-6
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL, rounds: int = ROUNDS) -> DataFrame:
    """`kind`, `host`, `score`: personalised PageRank of each kind, whose scores sum to 1.

    `edges`: kind, src, dst, share (of src's weight that goes to dst; 1 in all). `seeds`: kind, host, weight. A round is one join
    on (kind, host), whose hot hosts Spark splits, and aggregations that combine before the shuffle; its scores are written,
    and two sums by kind come to the driver: what was passed on (the rest returns to the seeds) and how far scores moved.
    """
    spark = edges.sparkSession
    sums = {r.kind: r.total for r in seeds.groupBy("kind").agg(F.sum("weight").alias("total")).collect()}
    by_kind = lambda values: F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in values.items()], F.lit(0.0))
    start, first = stash_at(seeds.select("kind", "host", (F.col("weight") / by_kind(sums)).alias("score")), "host-scores")
    scores, path = start, None
    for _ in range(rounds):
        moved = scores.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("score"))
        moved, moved_path = stash_at(moved, "host-flow")
        passed = {r.kind: r.total for r in moved.groupBy("kind").agg(F.sum("score").alias("total")).collect()}
        back = start.select("kind", "host", (F.col("score") * (1 - damping * by_kind(passed))).alias("score"))
        new, new_path = stash_at(moved.select("kind", "host", (F.col("score") * damping).alias("score")).union(back).groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
        gap = new.union(scores.select("kind", "host", -F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("d")).groupBy("kind").agg(F.sum(F.abs("d")).alias("d")).agg(F.max("d")).first()[0]
        discard(spark, moved_path)
        if path:
            discard(spark, path)
        scores, path = new, new_path
        if not gap or gap < residual:
            break
    discard(spark, first)
    return scores


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: `id`, `host`, `path`, `rule`, `verdict`.

    A null url, or one without `://`, has empty host and path, fits no rule and is allowed unless links from the empty host
    say otherwise (it takes no part in the link graph). A null html has no links. Rows may repeat: each counts. An empty
    table gives an empty result.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = pages.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(F.regexp_extract_all("html", F.lit(LINK)), F.array()).alias("links"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = stash(pages.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.array_distinct(F.transform("links", lambda x: F.translate(x, UPPER, LOWER))).alias("links")), "pages")

    named = judged.filter("host <> ''")
    hosts = named.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"))
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("n")).alias("weight")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("n")).alias("weight")))).alias("s")).select("s.kind", "host", "s.weight").filter("weight > 0")
    links = named.select(F.col("host").alias("src"), F.explode("links").alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = stash(links, "host-links")
    ways = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n")))
    totals = ways.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = ways.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share"))
    scores = propagate(stash(edges, "host-edges"), stash(seeds, "host-seeds"))
    bad = scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    bad = bad.filter(F.col("distrust") > threshold * (1 + LEAD) * F.col("trust")).select("host", F.lit("block").alias("by_links"))
    return judged.drop("links").join(bad, "host", "left").select("id", "host", "path", "rule", F.coalesce("by_rule", "by_links", F.lit("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


#: Rounds that the SQL unrolls.
SQL_ROUNDS = 30


def _oracle() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else k}'" for k, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    rounds = [
        f"f{r} AS MATERIALIZED (SELECT e.kind, e.dst AS host, sum(s.score * e.share) AS score FROM s{r - 1} s JOIN edges e ON e.kind = s.kind AND e.src = s.host GROUP BY ALL), "
        f"s{r} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, {DAMPING} * score AS score FROM f{r} UNION ALL "
        f"SELECT s.kind, s.host, s.score * (1 - {DAMPING} * coalesce(p.score, 0)) FROM s0 s LEFT JOIN (SELECT kind, sum(score) AS score FROM f{r} GROUP BY kind) p USING (kind)) GROUP BY ALL)"
        for r in range(1, SQL_ROUNDS + 1)
    ]
    link = LINK.removeprefix("(?i)").replace("'", "''")
    return f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, html
  FROM pages),
j AS (SELECT page_id, host, path, {cases("rule")} AS rule, {cases("verdict")} AS by_rule, html FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, good / n AS weight FROM h WHERE good > 0 UNION ALL SELECT 'distrust', host, bad / n FROM h WHERE bad > 0),
l AS (SELECT src, dst, count(*) AS n FROM (
        SELECT DISTINCT page_id, src, translate(x, '{UPPER}', '{LOWER}') AS dst
        FROM (SELECT page_id, host AS src, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS x FROM j WHERE host <> ''))
      WHERE src <> dst GROUP BY src, dst),
w AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
edges AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM w),
s0 AS MATERIALIZED (SELECT kind, host, weight / sum(weight) OVER (PARTITION BY kind) AS score FROM seeds),
{", ".join(rounds)},
b AS (SELECT host FROM s{SQL_ROUNDS} GROUP BY host
      HAVING sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) > {THRESHOLD * (1 + LEAD)!r} * sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM b) THEN 'block' END, 'allow') AS verdict FROM j
"""


ORACLE = _oracle()
