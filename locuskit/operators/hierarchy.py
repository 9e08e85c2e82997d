"""Repair and checks of gene, transcript and part rows: duplicate identifiers, missing parents and exons, spans, strands, phases.

Rows have row_idx (their order), seqid, source, feature, start, end, strand, phase, id (or null) and parents (array). Each step
is a window per identifier, a join on identifiers, or a grouping by parent; no step holds more than one gene's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, text
from locuskit.operators import islands
from locuskit.session import written
from locuskit.sources.writers import TRANSCRIPTS

#: Features that stand for exons, and all parts of a transcript.
EXON_LIKE = ("exon", "five_prime_utr", "three_prime_utr", "utr")
PARTS = (*EXON_LIKE, "cds", "start_codon", "stop_codon")


def kind_of(feature: Column) -> Column:
    f = F.lower(feature)
    return F.when(f == "gene", "gene").when(f.isin(*TRANSCRIPTS), "transcript").when(f.isin(*PARTS), "child").otherwise("other")


def unique_ids(rows: DataFrame, base: str, order: str, name: str) -> DataFrame:
    """`name`: the base of the first row that has it; `.dup02` and on for later ones, passing over names that exist."""
    k = F.row_number().over(W.partitionBy(base).orderBy(order))
    own = F.regexp_extract(F.col(base), r"^(.*)\.dup(\d+)$", 1)
    taken = rows.filter(own != "").select(own.alias("__base"), F.regexp_extract(F.col(base), r"^(.*)\.dup(\d+)$", 2).try_cast("int").alias("n")).groupBy("__base").agg(F.array_sort(F.collect_set("n")).alias("__taken"))
    made = rows.withColumn("__k", k).join(taken, F.col(base) == F.col("__base"), "left")
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__k"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return made.withColumn(name, F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat(base, F.lit(".dup"), text.numbered_id("", free, 2)))).drop("__k", "__base", "__taken")


def disambiguated(rows: DataFrame) -> DataFrame:
    """`final_id` and `final_parents`: repeated identifiers of genes and transcripts get a suffix in the order of rows, and a
    parent is the last row of that identifier above the child."""
    named = rows.filter(F.lower("feature").isin("gene", "mrna", "transcript", "rna") & F.col("id").isNotNull() & (F.col("id") != ""))
    own, _ = written(unique_ids(named.select("row_idx", "id"), "id", "row_idx", "final_id"), "own-ids")
    above = rows.select("row_idx", F.posexplode("parents").alias("pos", "id")).filter("id <> ''")
    # A row is no parent of its own: what counts is above it.
    met = islands.as_of(above.withColumn("at", F.col("row_idx") - 1), own.withColumn("at", F.col("row_idx")).select("id", "at", "final_id"), ["id"], "at", "final_id")
    parents = met.groupBy("row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("last_value", "id").alias("p")))), lambda x: x["p"]).alias("final_parents"))
    return rows.join(own.select("row_idx", "final_id"), "row_idx", "left").join(parents, "row_idx", "left").withColumns({"final_id": F.coalesce("final_id", "id"), "final_parents": F.coalesce("final_parents", "parents")})


def repaired(rows: DataFrame, source_label: str = "") -> DataFrame:
    """The rows of a release: row_idx, seqid, source, feature, start, end, strand, phase, id, parents, repair (what was made), old_id.

    Genes without or with repeated identifiers get new ones; a transcript without a gene, or whose gene isn't there, gets a
    made one; one that is called like its gene is renamed `.t01` and on; parts follow their transcripts' names and strand;
    phases are 0, 1, 2 for coding parts (0 if unknown) and a dot for others; a transcript without exons gets them from its
    coding parts and UTRs; spans of transcripts and genes cover what lies below them. A row of several parents stays one row,
    parts without any known parent go.
    """
    cols = ["row_idx", "seqid", "source", "feature", "start", "end", "strand", "phase", "id", "parents"]
    r, _ = written(rows.select(*cols).withColumn("kind", kind_of(F.col("feature"))), "release-rows")
    label = (lambda c: F.lit(source_label)) if source_label else F.col
    genes = unique_ids(r.filter("kind = 'gene'").withColumn("base", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("gene_"), F.col("row_idx").cast("string")))), "base", "row_idx", "new_id")
    genes, _ = written(genes.select("row_idx", "seqid", "source", "start", "end", "strand", F.col("id").alias("old_id"), F.col("new_id").alias("id")), "genes")

    t = r.filter("kind = 'transcript'").withColumn("old", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("transcript_"), F.col("row_idx").cast("string"))))
    t = t.groupBy("old").agg(F.max_by(F.struct(*cols), "row_idx").alias("r")).select("old", "r.*").withColumn("gene", F.coalesce(F.get("parents", F.lit(0)), F.lit("")))
    known = genes.select(F.col("id").alias("gene"), F.lit(True).alias("there"))
    lone = t.filter("gene = ''").join(genes.select(F.col("id").alias("old"), F.lit(True).alias("same")), "old", "left").withColumn("gene", F.when(F.col("same"), F.concat("old", F.lit(".gene"))).otherwise(F.col("old"))).drop("same")
    t, _ = written(t.filter("gene <> ''").unionByName(lone).join(known, "gene", "left"), "transcripts")
    made = t.filter("there is null").groupBy("gene").agg(F.min_by(F.struct("seqid", "source", "start", "end", "strand", "row_idx", (F.size("parents") == 0).alias("top")), "row_idx").alias("r"))
    repair = F.when(F.col("r.top"), "synthetic_gene_from_top_level_transcript").otherwise("synthetic_gene_from_transcript_parent")
    made = made.select((F.col("r.row_idx") - 0.1).alias("row_idx"), "r.seqid", label("r.source").alias("source"), "r.start", "r.end", "r.strand", F.lit("").alias("old_id"), F.col("gene").alias("id"), repair.alias("repair"))
    genes = genes.withColumns({"row_idx": F.col("row_idx").cast("double"), "repair": F.lit("")}).unionByName(made)

    k = F.row_number().over(W.partitionBy("gene").orderBy("row_idx"))
    clash = genes.select(F.col("id").alias("old"), F.lit(True).alias("clash"))
    new = F.when(F.col("clash"), F.concat("gene", F.lit(".t"), text.numbered_id("", F.col("k"), 2))).otherwise(F.col("old"))
    named = unique_ids(t.withColumn("k", k).join(clash, "old", "left").withColumn("base", new), "base", "row_idx", "new_id")
    tx, _ = written(named.select("row_idx", "seqid", "source", "feature", "start", "end", "strand", "phase", "old", "gene", "new_id"), "named")

    c = r.filter("kind = 'child'").select("row_idx", F.explode("parents").alias("p"))
    to_tx = c.join(tx.select(F.col("old").alias("p"), F.col("new_id").alias("tx"), F.col("strand").alias("ps")), "p")
    to_gene = c.join(tx.select(F.col("old").alias("p")), "p", "left_anti").join(genes.select(F.col("id").alias("p"), F.col("strand").alias("ps")), "p").select("row_idx", F.col("p").alias("parent"), "ps", F.lit(None).cast("string").alias("tx"))
    tied, _ = written(to_tx.select("row_idx", F.col("tx").alias("parent"), "ps", "tx").unionByName(to_gene), "tied")
    per = tied.groupBy("row_idx").agg(F.array_sort(F.collect_set("parent")).alias("parents"), F.collect_set("ps").alias("strands"))
    low = F.lower("feature")
    phase = F.when(low == "cds", F.when(F.col("phase").isin("0", "1", "2"), F.col("phase")).otherwise("0")).otherwise(".")
    child = r.filter("kind = 'child'").drop("parents").join(per, "row_idx").withColumns({"phase": phase, "strand": F.when(F.size("strands") == 1, F.col("strands")[0]).otherwise(F.col("strand")), "old_id": F.col("id")})
    own = low.isin("exon", "cds") & (F.coalesce("id", F.lit("")) != "")
    child = unique_ids(child.filter(own), "id", "row_idx", "new").unionByName(child.filter(~own).withColumn("new", F.col("id")))
    child, _ = written(child.select(F.col("row_idx").cast("double").alias("row_idx"), "seqid", "source", "feature", "start", "end", "strand", "phase", F.col("new").alias("id"), "parents", "old_id"), "parts")

    below = tied.filter("tx is not null").select("row_idx", "tx").join(child.select(F.col("row_idx").cast("long").alias("row_idx"), "start", "end", "feature"), "row_idx")
    seed = F.when(F.lower("feature").isin(*EXON_LIKE, "cds"), F.struct("start", "end"))
    spans = below.groupBy("tx").agg(F.min("start").alias("c0"), F.max("end").alias("c1"), (F.count_if(F.lower("feature") == "exon") > 0).alias("has"), F.array_sort(F.collect_set(seed)).alias("seeds"))
    whole, _ = written(tx.join(spans, F.col("new_id") == F.col("tx"), "left").withColumns({"start": F.least("start", "c0"), "end": F.greatest("end", "c1")}), "spans")
    lost = whole.filter("not has and size(seeds) > 0").select("row_idx", "seqid", "source", "strand", "new_id", F.posexplode(intervals.merged(F.col("seeds"))).alias("pos", "b"))
    exons = lost.select((F.col("row_idx") + (F.col("pos") + 1) / 100000.0).alias("row_idx"), "seqid", label("source").alias("source"), F.lit("exon").alias("feature"), "b.start", "b.end", "strand", F.lit(".").alias("phase"), F.concat("new_id", F.lit(".exon"), text.numbered_id("", F.col("pos") + 1, 3)).alias("id"), F.array("new_id").alias("parents"), F.lit("synthetic_exon_from_cds_or_utr").alias("repair"), F.lit("").alias("old_id"))
    reach = whole.groupBy(F.col("gene").alias("id")).agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    none = F.array().cast("array<string>")
    out = genes.join(reach, "id", "left").select("row_idx", "seqid", "source", F.lit("gene").alias("feature"), F.least("start", "t0").alias("start"), F.greatest("end", "t1").alias("end"), "strand", F.lit(".").alias("phase"), "id", none.alias("parents"), "repair", "old_id")
    out = out.unionByName(whole.select(F.col("row_idx").cast("double").alias("row_idx"), "seqid", "source", "feature", "start", "end", "strand", F.lit(".").alias("phase"), F.col("new_id").alias("id"), F.array("gene").alias("parents"), F.lit("").alias("repair"), F.col("old").alias("old_id")))
    out = out.unionByName(child.withColumn("repair", F.lit(""))).unionByName(exons)
    rest = r.filter("kind = 'other'").select(F.col("row_idx").cast("double").alias("row_idx"), *cols[1:], F.lit("").alias("repair"), F.col("id").alias("old_id"))
    return out.unionByName(rest)


def post_checks(rows: DataFrame) -> DataFrame:
    """(check, n): repeated identifiers of genes, transcripts and exons, wrong phases, parents that are missing or don't hold a
    child (other sequence, opposite strands, a child that reaches beyond)."""
    low = F.lower("feature")
    main = (low == "gene") | low.isin(*TRANSCRIPTS) | (low == "exon")
    ids = rows.filter("id is not null and id <> ''")
    twice = ids.groupBy("id").agg(F.count_if(main).alias("n"), F.min_by(main, "row_idx").alias("first")).select(F.when(F.col("first"), F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("n")).alias("n")).agg(F.sum("n").alias("n")).select(F.lit("duplicate_gene_tx_exon_ids").alias("check"), "n")
    phases = rows.agg(F.count_if((low == "cds") & ~F.col("phase").isin("0", "1", "2")).alias("a"), F.count_if((low != "cds") & (F.col("phase") != ".")).alias("b")).select(F.explode(F.array(F.struct(F.lit("invalid_cds_phase").alias("check"), F.col("a").alias("n")), F.struct(F.lit("invalid_non_cds_phase").alias("check"), F.col("b").alias("n")))).alias("x")).select("x.*")
    first = ids.groupBy("id").agg(F.min_by(F.struct("seqid", "start", "end", "strand"), "row_idx").alias("p"))
    met = rows.select("seqid", "start", "end", "strand", F.explode("parents").alias("parent")).join(first, F.col("parent") == F.col("id"), "left")
    apart = (F.col("seqid") != F.col("p.seqid")) | (F.col("strand").isin("+", "-") & F.col("p.strand").isin("+", "-") & (F.col("strand") != F.col("p.strand"))) | (F.col("start") < F.col("p.start")) | (F.col("end") > F.col("p.end"))
    found = met.agg(F.count_if(F.col("p").isNull()).alias("a"), F.count_if(F.coalesce(apart, F.lit(False))).alias("b")).select(F.explode(F.array(F.struct(F.lit("missing_parent_refs").alias("check"), F.col("a").alias("n")), F.struct(F.lit("child_outside_parent").alias("check"), F.col("b").alias("n")))).alias("x")).select("x.*")
    return twice.union(phases).union(found).select("check", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
