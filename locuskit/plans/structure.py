"""Projections, scalar functions, sets, windows and orders over gene models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, sequence, text
from locuskit.operators import islands, tables
from locuskit.plans.registry import query
from locuskit.plans.views import exons, hits, introns, table, transcripts


@query("SELECT tx_id, seqid, source, strand, gene_id, s AS start, e AS \"end\", n AS n_exons FROM tx")
def p01_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("tx_id", "seqid", "source", "strand", "gene_id", "start", "end", F.size("blocks").cast("long").alias("n_exons"))


@query("SELECT tx_id, string_agg(s || '-' || e, ',' ORDER BY s, e) AS exons FROM (SELECT DISTINCT tx_id, s, e FROM exon) GROUP BY tx_id")
def p02_sorted_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("tx_id", intervals.shown(intervals.ordered(F.col("blocks"))).alias("exons"))


@query("SELECT tx_id, string_agg(s || '-' || e, ',' ORDER BY s, e) AS introns FROM intron GROUP BY tx_id")
def p05_proper_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).filter(F.size("gaps") > 0).select("tx_id", intervals.shown(F.col("gaps")).alias("introns"))


@query("SELECT tx_id, string_agg(gs || '-' || ge, ',' ORDER BY s, e) AS introns FROM pair WHERE gs IS NOT NULL GROUP BY tx_id")
def p04_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).filter(F.size("blocks") > 1).select("tx_id", intervals.shown(intervals.introns(F.col("blocks"))).alias("introns"))


@query("SELECT signature, count(*) AS n FROM (SELECT seqid || '|' || strand || '|' || string_agg(s || '-' || e, ',' ORDER BY s, e) AS signature FROM intron GROUP BY tx_id, seqid, strand) GROUP BY signature")
def p06_chain_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).filter(F.size("gaps") > 0)
    return t.select(intervals.signature(F.col("seqid"), F.col("strand"), F.col("gaps")).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


@query("SELECT tx_id, count(DISTINCT x) AS n_sites, min(x) AS first_site, max(x) AS last_site FROM (SELECT tx_id, s AS x FROM intron UNION ALL SELECT tx_id, e FROM intron) GROUP BY tx_id")
def p08_splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = transcripts(spark, sf_dir).filter(F.size("gaps") > 0).select("tx_id", intervals.sites(F.col("gaps")).alias("x"))
    return sites.select("tx_id", F.size("x").cast("long").alias("n_sites"), F.array_min("x").alias("first_site"), F.array_max("x").alias("last_site"))


@query("SELECT tx_id, sum(e - s + 1)::BIGINT AS exon_bp, coalesce((SELECT sum(c.e - c.s + 1) FROM cds c WHERE c.tx_id = x.tx_id), 0)::BIGINT AS coding_bp FROM exon x GROUP BY tx_id")
def p10_block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("tx_id", intervals.length(F.col("blocks")).alias("exon_bp"), intervals.length(F.col("coding")).alias("coding_bp"))


@query(r"SELECT o_orderkey, regexp_replace(tx, '(\.t\d+|-mrna-?\d+)$', '', 'i') AS gene FROM (SELECT o_orderkey, 'g' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN '.t1' WHEN 1 THEN '-mRNA-2' WHEN 2 THEN '.T3' ELSE '_x' END AS tx FROM orders)", views=False)
def p11_infer_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    tx = F.concat(F.lit("g"), F.col("o_custkey").cast("string"), F.when(k == 0, ".t1").when(k == 1, "-mRNA-2").when(k == 2, ".T3").otherwise("_x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.inferred_gene(tx).alias("gene"))


@query("SELECT source || ':' || gene_id || ':' || tx_id AS model_id, source AS s1, gene_id AS s2, tx_id::VARCHAR AS s3 FROM tx")
def p13_model_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transcripts(spark, sf_dir).select(F.concat_ws(":", text.safe_id(F.col("source")), text.safe_id(F.col("gene_id")), text.safe_id(F.col("tx_id").cast("string"))).alias("model_id"))
    parts = F.split("model_id", ":", 3)
    return made.select("model_id", parts[0].alias("s1"), parts[1].alias("s2"), parts[2].alias("s3"))


@query("""SELECT tx_id, s AS start, ((3 - coalesce(sum(e - s + 1) OVER (PARTITION BY tx_id ORDER BY CASE strand WHEN '-' THEN -s ELSE s END, CASE strand WHEN '-' THEN -e ELSE e END
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3)::INTEGER AS phase FROM cds""")
def p15_coding_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).filter(F.size("coding") > 0)
    both = F.arrays_zip(intervals.coding_order(F.col("coding"), F.col("strand")).alias("b"), intervals.phases(F.col("coding"), F.col("strand")).alias("p"))
    return t.select("tx_id", F.explode(both).alias("z")).select("tx_id", F.col("z.b.start").alias("start"), F.col("z.p").alias("phase"))


_ALIASES = """WITH RECURSIVE l(p_partkey, rest, alias) AS (
  SELECT p_partkey, p_partkey::BIGINT, '' FROM part UNION ALL SELECT p_partkey, (rest - 1) // 26, chr((65 + (rest - 1) % 26)::INTEGER) || alias FROM l WHERE rest > 0)
SELECT p_partkey, CASE WHEN p_partkey < 1 THEN 'A' ELSE alias END AS alias, 'S' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS set_alias FROM l WHERE rest <= 0"""


@query(_ALIASES, views=False)
def p19_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.letters(k).alias("alias"), text.numbered_id("S", k % 100, 2).alias("set_alias"))


@query("SELECT l_suppkey, 'GeneG' || CASE WHEN length(l_suppkey::VARCHAR) < 6 THEN lpad(l_suppkey::VARCHAR, 6, '0') ELSE l_suppkey::VARCHAR END AS gene, 'GeneT' || CASE WHEN length(l_suppkey::VARCHAR) < 6 THEN lpad(l_suppkey::VARCHAR, 6, '0') ELSE l_suppkey::VARCHAR END AS tx, l_suppkey AS number FROM (SELECT DISTINCT l_suppkey FROM lineitem)", views=False)
def p30_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().withColumn("gene", text.numbered_id("GeneG", F.col("l_suppkey"), 6))
    return ids.select("l_suppkey", "gene", text.transcript_of(F.col("gene")).alias("tx"), text.id_parts(F.col("gene"))["number"].alias("number"))


@query("SELECT o_orderkey, o_orderstatus AS status, 'x' || o_custkey AS parent, 'a;b' AS note, 3::BIGINT AS n FROM orders", views=False)
def x01_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("ID=1;Parent=x"), F.col("o_custkey").cast("string"), F.lit("; Note=a%3Bb;status=none;status="), F.col("o_orderstatus"))
    pairs = text.attribute_pairs(line)
    found = text.attribute_map(text.attribute_pairs(F.concat(F.lit('gene_id "g1"; transcript_id "t2"; n 3'))))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.attribute(pairs, "status").alias("status"), text.attribute(pairs, "geneID", "Parent").alias("parent"),
        text.decoded(text.attribute(pairs, "Note")).alias("note"), F.size(F.map_keys(found)).cast("long").alias("n"),
    )


@query("SELECT p_partkey, replace(replace(p_name, '%', '%25'), ' ', '%20') AS coded, p_name AS decoded FROM part", views=False)
def x04_percent_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("coded", text.encoded(F.col("p_name"))).select("p_partkey", "coded", text.decoded(F.col("coded")).alias("decoded"))


@query("SELECT o_orderkey, len(list_filter(string_split(replace(x, ';', ','), ','), lambda y: trim(y) <> ''))::BIGINT AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'c' ELSE 'b' END AS last FROM (SELECT o_orderkey, o_orderstatus, o_orderstatus || ', ;b;;' || CASE WHEN o_orderkey % 3 = 0 THEN 'c' ELSE '' END AS x FROM orders)", views=False)
def x05_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.col("o_orderstatus"), F.lit(", ;b;;"), F.when(F.col("o_orderkey") % 3 == 0, "c").otherwise(""))
    items = text.split_list(x)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(items).cast("long").alias("n"), F.element_at(items, -1).alias("last"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the documents' characters as nucleotides, by a fixed mapping of lower-case letters."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


GENOME = "WITH g AS (SELECT doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)\n"


@query(GENOME + "SELECT doc_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM g", views=False)
def x06_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome(spark, sf_dir).select("doc_id", F.md5(sequence.reverse_complement(F.col("seq"))).alias("digest"))


@query(GENOME + "SELECT doc_id, CASE WHEN length(seq) >= 60 THEN substr(seq, 11, 50) ELSE '' END AS part FROM g", views=False)
def x07_bounded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome(spark, sf_dir).select("doc_id", sequence.cut(F.col("seq"), F.lit(11), F.lit(60)).alias("part"))


@query(GENOME + """SELECT doc_id, length(cds)::BIGINT AS n, regexp_matches(left(cds, 3 * greatest((length(cds) // 3)::BIGINT - 1, 0)), '^(...)*?(TAA|TAG|TGA)') AS inner_stop,
  right(cds, 3) IN ('TAA', 'TAG', 'TGA') AS stop, left(cds, 3) = 'ATG' AS start, (length(cds) % 3)::BIGINT AS rest FROM (SELECT doc_id, seq AS cds FROM g)""", views=False)
def x09_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = F.col("seq")
    return genome(spark, sf_dir).select(
        "doc_id", F.length(cds).cast("long").alias("n"), sequence.has_inner_stop(cds).alias("inner_stop"), sequence.ends_in_stop(cds).alias("stop"), sequence.begins_with_start(cds).alias("start"), (F.length(cds) % 3).cast("long").alias("rest")
    )


@query(GENOME + """SELECT doc_id, CASE WHEN length(seq) >= 90 THEN x || '-' || y END AS motif, CASE WHEN length(seq) >= 90 THEN x || '-' || y IN ('GT-AG', 'GC-AG', 'AT-AC') END AS canonical
  FROM (SELECT doc_id, seq, left(i, 2) AS x, right(i, 2) AS y FROM (SELECT doc_id, seq, CASE doc_id % 2 WHEN 0 THEN substr(seq, 21, 70) ELSE reverse(translate(substr(seq, 21, 70), 'ACGT', 'TGCA')) END AS i FROM g))""", views=False)
def x12_splice_motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    made = genome(spark, sf_dir).select("doc_id", sequence.motif(F.col("seq"), F.lit(21), F.lit(90), strand).alias("motif"))
    return made.select("doc_id", "motif", sequence.canonical(F.col("motif")).alias("canonical"))


@query("SELECT event_id, lower(trim(event_type)) IN ('true', '1', 'yes', 'y', 'click') AS flag, coalesce(trunc(try_cast(v AS DOUBLE))::INTEGER, 0) AS number FROM (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN '12.7' ELSE event_id::VARCHAR END AS v FROM events)", views=False)
def x17_tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, "x").when(F.col("event_id") % 3 == 1, "12.7").otherwise(F.col("event_id").cast("string"))
    word = F.when(F.col("event_type") == "click", " Yes ").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.truth(word).alias("flag"), text.whole_number(v).cast("int").alias("number"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events", views=False)
def x19_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost object of a reply that may stand in a fence or among words."""
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "k bigint")["k"].alias("k"))


@query("SELECT c_custkey, sha256(c_name) AS digest FROM customer", views=False)
def x25_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))


_BOTH = """, a AS (SELECT tx_id, tx_id // 4 AS w, source, list_sort(list_distinct(list(s || '-' || e))) AS x FROM intron GROUP BY ALL)
SELECT a.tx_id AS tx_a, b.tx_id AS tx_b, len(list_intersect(a.x, b.x)) AS shared, len(list_distinct(list_concat(a.x, b.x))) AS union_size,
  len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS jaccard, NOT list_has_any(a.x, b.x) AS apart, len(list_filter(a.x, lambda v: NOT list_contains(b.x, v))) AS only_a
FROM a JOIN a b ON a.w = b.w AND a.tx_id < b.tx_id"""


@query(_BOTH)
def u05_intron_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union, difference, disjointness and similarity of intron sets within a window."""
    t = transcripts(spark, sf_dir).filter(F.size("gaps") > 0).select("tx_id", F.floor(F.col("tx_id") / 4).alias("w"), "gaps")
    b = t.select(F.col("tx_id").alias("tx_b"), "w", F.col("gaps").alias("gaps_b"))
    both = t.join(b, "w").filter("tx_id < tx_b")
    x, y = F.col("gaps"), F.col("gaps_b")
    return both.select(
        F.col("tx_id").alias("tx_a"), "tx_b", F.size(F.array_intersect(x, y)).cast("long").alias("shared"), F.size(F.array_union(x, y)).cast("long").alias("union_size"),
        intervals.jaccard(x, y).alias("jaccard"), (~F.arrays_overlap(x, y)).alias("apart"), F.size(F.array_except(F.array_distinct(x), y)).cast("long").alias("only_a"),
    )


@query(", l AS (SELECT *, max(e) OVER (PARTITION BY gene_id, seqid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM exon), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id, seqid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT gene_id, seqid, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM i GROUP BY gene_id, seqid, g")
def a11_merged_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.merge_intervals(exons(spark, sf_dir).select("gene_id", "seqid", "start", "end"), ["gene_id", "seqid"])


@query(", l AS (SELECT *, max(e) OVER (PARTITION BY tx_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM exon), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tx_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM l), o AS (SELECT tx_id, g, min(s) AS s, max(e) AS e FROM i GROUP BY tx_id, g) SELECT tx_id, string_agg(s || '-' || e, ',' ORDER BY s) AS blocks, sum(e - s + 1)::BIGINT AS covered FROM o GROUP BY tx_id")
def a12_merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).withColumn("m", intervals.merged(F.col("blocks")))
    return t.select("tx_id", intervals.shown(F.col("m")).alias("blocks"), intervals.length(F.col("m")).alias("covered"))


@query("SELECT tx_id, s AS start, row_number() OVER (PARTITION BY tx_id ORDER BY CASE strand WHEN '-' THEN -s ELSE s END, CASE strand WHEN '-' THEN -e ELSE e END) AS number FROM exon")
def w04_exon_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    order = W.partitionBy("tx_id").orderBy(sign * F.col("start"), sign * F.col("end"))
    return exons(spark, sf_dir).select("tx_id", "start", F.row_number().over(order).cast("long").alias("number"))


@query("SELECT gene_id, max_by(tx_id, (e - s + 1) * 1000000 - tx_id) AS tx_id, max(e - s + 1) AS span FROM tx GROUP BY gene_id")
def w05_longest_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir).select("gene_id", "tx_id", (F.col("end") - F.col("start") + 1).alias("span"))
    return tables.first_of_key(t, ["gene_id"], -F.col("span"), F.col("tx_id"))


@query("SELECT tx_id, CASE WHEN k = 1 THEN gene_id ELSE gene_id || '.dup' || lpad(k::VARCHAR, 2, '0') END AS unique_id FROM (SELECT tx_id, gene_id, row_number() OVER (PARTITION BY gene_id ORDER BY tx_id) AS k FROM tx)")
def w06_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(W.partitionBy("gene_id").orderBy("tx_id"))
    return exons(spark, sf_dir).select("tx_id", "gene_id").distinct().withColumn("k", k).select("tx_id", F.when(F.col("k") == 1, F.col("gene_id")).otherwise(F.concat("gene_id", F.lit(".dup"), text.numbered_id("", F.col("k"), 2))).alias("unique_id"))


@query("SELECT tx_id, s AS start, s - lag(e) OVER w - 1 AS gap_before, lead(s) OVER w - e - 1 AS gap_after FROM exon WINDOW w AS (PARTITION BY tx_id ORDER BY s, e)")
def w08_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("tx_id").orderBy("start", "end")
    return exons(spark, sf_dir).select("tx_id", "start", (F.col("start") - F.lag("end").over(order) - 1).alias("gap_before"), (F.lead("start").over(order) - F.col("end") - 1).alias("gap_after"))


@query("SELECT hit_id, last_value(CASE WHEN strand <> '.' THEN hit_id END IGNORE NULLS) OVER (PARTITION BY seqid ORDER BY s ROWS UNBOUNDED PRECEDING) AS head FROM hit")
def w10_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("head", F.when(F.col("strand") != ".", F.col("hit_id")))
    return islands.forward_fill(h, ["seqid"], "start", "head").select("hit_id", "head")


@query("SELECT gene_id, d[len(d) // 2 + 1] AS step FROM (SELECT gene_id, list_sort(list(d)) AS d FROM (SELECT gene_id, s - lag(s) OVER (PARTITION BY gene_id ORDER BY s, tx_id) AS d FROM tx) WHERE d IS NOT NULL GROUP BY gene_id)")
def w12_median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transcripts(spark, sf_dir).select("gene_id", (F.col("start") - F.lag("start").over(W.partitionBy("gene_id").orderBy("start", "tx_id"))).alias("d")).filter("d is not null")
    return islands.upper_median(d, ["gene_id"], "d", "step")


@query("SELECT n_name, row_number() OVER (ORDER BY n_nationkey % 12, n_nationkey) AS place FROM nation", views=False)
def o01_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr2 before chr10: numbers inside names sort by value."""
    n = table(spark, sf_dir, "nation").withColumn("seqid", F.concat(F.lit("chr"), (F.col("n_nationkey") % 12).cast("string")))
    return islands.numbered(n, ["n_nationkey"], "place", [text.natural_key(F.col("seqid"))]).select("n_name", "place")


@query("SELECT tx_id, CASE source WHEN 'ToolB' THEN 1 WHEN 'current' THEN 2 ELSE 3 END AS rank FROM tx")
def o06_source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exons(spark, sf_dir).select("tx_id", "source").distinct().select("tx_id", tables.rank_in(F.col("source"), ("ToolB", "current")).alias("rank"))


@query("SELECT gene_id, tx_id, k FROM (SELECT gene_id, tx_id, row_number() OVER (PARTITION BY gene_id ORDER BY n DESC, tx_id) AS k FROM tx) WHERE k <= 3")
def o08_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = exons(spark, sf_dir).groupBy("gene_id", "tx_id").agg(F.count("*").alias("n"))
    return tables.top_of_key(t, ["gene_id"], 3, "k", F.desc("n"), F.col("tx_id")).select("gene_id", "tx_id", "k")


@query("SELECT tx_id, row_number() OVER (ORDER BY seqid, s, e, tx_id) AS number FROM tx")
def w02_genome_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.numbered(transcripts(spark, sf_dir).select("tx_id", "seqid", "start", "end"), ["start", "end", "tx_id"], "number", ["seqid", F.floor(F.col("start") / islands.BIN)]).select("tx_id", "number")


@query("SELECT tx_id, s AS start, e AS \"end\" FROM intron")
def s05_intron_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introns(spark, sf_dir).select("tx_id", "start", "end")
