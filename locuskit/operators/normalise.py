"""Annotation files of any source as a complete hierarchy of genes, transcripts and parts, with counts of what was mended.

All files go through together, keyed by `file`; genes and transcripts are groupings over the rows that belong to them, so the
order of rows matters only where the first or last of several values counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.session import written

#: Features of transcripts, and what the counts of a file are called by the feature's exact name.
TRANSCRIPTS = ("mrna", "transcript", "rna")
COUNTED = {"original_gene_features": ("gene",), "original_mrna_features": ("mRNA", "transcript", "RNA", "rna"), "original_exon_features": ("exon",), "original_cds_features": ("CDS",)}


def _filled(name: str) -> Column:
    """The first value of the rows of a group that is neither empty nor a dot."""
    c = F.col(name)
    return F.coalesce(F.min_by(name, F.when((c != "") & (c != "."), F.col("row_idx"))), F.lit(".")).alias(name)


def _text(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat_ws(";", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), text.encoded(v))) for k, v in pairs])


def hierarchy(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, transcripts, parts) of GFF rows (file, row_idx, seqid, source, feature, start, end, score, strand, phase, attributes).

    A gene row without ID or Name gets a number of its own, a transcript without either is left out. A transcript belongs to
    its first parent, of several rows to that of the last; without one its gene is inferred from its name, as is the gene of a
    transcript that only parts name. Genes that no row lists, or that were inferred for a transcript, are marked. Spans cover
    all rows below; sequence, strand, score and source are the first ones given.
    """
    pairs = text.attribute_pairs(F.col("attributes"))
    name = text.attribute(pairs, "ID", "Name")
    kind = F.when(F.lower("feature") == "gene", "gene").when(F.lower("feature").isin(*TRANSCRIPTS), "tx").when(F.lower("feature").isin("exon", "cds"), "part")
    keep = ["file", "row_idx", "seqid", "source", "start", "end", "score", "strand", "phase"]
    r, _ = written(rows.select(*keep, F.lower("feature").alias("feature"), kind.alias("kind"), name.alias("name"), text.attribute(pairs, "Name").alias("called"), F.filter(F.split(F.coalesce(text.attribute(pairs, "Parent"), F.lit("")), ","), lambda x: x != "").alias("parents")), "features")
    lone = F.concat(F.lit("anonymous_gene_"), F.row_number().over(W.partitionBy("file", F.col("name").isNull()).orderBy("row_idx")).cast("string"))
    listed = r.filter("kind = 'gene'").withColumn("gene", F.coalesce("name", lone))
    parent = F.nullif(F.trim(F.get("parents", F.lit(0))), F.lit(""))
    t = r.filter("kind = 'tx' and name is not null").withColumns({"tx": F.col("name"), "orphan": parent.isNull()}).withColumn("gene", F.coalesce(parent, text.inferred_gene(F.col("tx"))))
    p = r.filter("kind = 'part'").withColumn("tx", F.explode("parents"))
    home = t.groupBy("file", "tx").agg(F.max_by("gene", "row_idx").alias("gene"), F.min_by("called", F.when(F.col("called").isNotNull(), -F.col("row_idx"))).alias("called"))
    parts = p.join(home.select("file", "tx", "gene"), ["file", "tx"], "left").withColumn("gene", F.coalesce("gene", text.inferred_gene(F.col("tx"))))
    parts, _ = written(parts.drop("name", "called", "parents", "kind"), "parts")
    own = ["file", "row_idx", "seqid", "source", "start", "end", "score", "strand"]
    below_tx = t.select(*own, "tx").unionByName(parts.select(*own, "tx"))
    span = [F.min("start").alias("start"), F.max("end").alias("end"), *map(_filled, ("seqid", "source", "score", "strand"))]
    homes = home.select("file", "tx", "gene", "called").unionByName(parts.select("file", "tx", "gene").distinct().join(home.select("file", "tx"), ["file", "tx"], "left_anti"), allowMissingColumns=True)
    transcripts = below_tx.groupBy("file", "tx").agg(*span).join(homes, ["file", "tx"])
    below_gene = listed.select(*own, "gene").unionByName(t.select(*own, "gene")).unionByName(parts.select(*own, "gene"))
    known = listed.groupBy("file", "gene").agg(F.max_by("called", F.when(F.col("called").isNotNull(), F.col("row_idx"))).alias("called"), F.lit(True).alias("listed"))
    orphans = t.filter("orphan").groupBy("file", "gene").agg(F.count("*").alias("orphans"))
    genes = below_gene.groupBy("file", "gene").agg(*span).join(known, ["file", "gene"], "left").join(orphans, ["file", "gene"], "left")
    genes = genes.withColumns({"inferred": F.col("listed").isNull() | F.col("orphans").isNotNull(), "orphans": F.coalesce("orphans", F.lit(0))}).drop("listed")
    return written(genes, "genes")[0], written(transcripts, "transcripts")[0], parts


def features(genes: DataFrame, transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """The hierarchy as GFF rows (file, seqid, source, feature, start, end, score, strand, phase, attributes) with `place`, by
    which a file is sorted: genes by sequence and place, their transcripts by start, exons and coding blocks numbered by place.

    A transcript without exons has its coding blocks as exons; phases other than 0, 1, 2 are dots.
    """
    c = F.col
    place = lambda tx, rank, at: F.struct(c("g_seqid"), c("g_start"), c("g_end"), c("gene"), *tx, F.lit(rank).alias("rank"), at.alias("at"))
    whole = genes.select("file", "gene", c("seqid").alias("g_seqid"), c("start").alias("g_start"), c("end").alias("g_end"))
    none = (F.lit(-1).cast("long").alias("t_start"), F.lit("").alias("tx"))
    start = lambda x: c(x).cast("long").alias("t_start")
    cols = ["file", "seqid", "source", "feature", "start", "end", "score", "strand", "phase", "attributes", "place"]
    g = genes.join(whole, ["file", "gene"]).withColumns({"feature": F.lit("gene"), "phase": F.lit("."), "attributes": _text([("ID", c("gene")), ("Name", F.coalesce("called", "gene")), ("source_name", c("file")), ("inferred_gene", F.when(c("inferred"), "true"))]), "place": place(none, 0, F.lit(0))}).select(*cols)
    t = transcripts.join(whole, ["file", "gene"])
    tx = t.withColumns({"feature": F.lit("mRNA"), "phase": F.lit("."), "attributes": _text([("ID", c("tx")), ("Parent", c("gene")), ("Name", F.coalesce("called", "tx")), ("source_name", c("file"))]), "place": place((start("start"), c("tx")), 1, F.lit(0))}).select(*cols)
    has = parts.filter("feature = 'exon'").select("file", "tx").distinct().withColumn("has", F.lit(True))
    bare = parts.filter("feature = 'cds'").join(has, ["file", "tx"], "left_anti").withColumns({"feature": F.lit("exon"), "score": F.lit(".")})
    head = t.select("file", "tx", c("start").alias("t0"), c("strand").alias("t_strand"), "g_seqid", "g_start", "g_end", c("gene").alias("home"))
    every = parts.unionByName(bare).drop("gene").join(head, ["file", "tx"]).withColumnRenamed("home", "gene")
    k = F.row_number().over(W.partitionBy("file", "tx", "feature").orderBy("start", "end", "row_idx"))
    named = F.when(c("feature") == "exon", "exon").otherwise("CDS")
    phase = F.when((c("feature") == "cds") & c("phase").isin("0", "1", "2"), c("phase")).otherwise(".")
    dot = lambda a, b: F.coalesce(F.when(~c(a).isin("", "."), c(a)), b)
    p = every.withColumn("k", k).withColumns({"at": c("k"), "attributes": _text([("ID", F.concat("tx", F.lit("."), named, F.lit("."), c("k").cast("string"))), ("Parent", c("tx"))]), "strand": dot("strand", c("t_strand")), "score": dot("score", F.lit(".")), "phase": phase})
    p = p.withColumn("place", F.struct(c("g_seqid"), c("g_start"), c("g_end"), c("gene"), start("t0"), c("tx"), F.when(c("feature") == "exon", 2).otherwise(3).alias("rank"), c("at"))).withColumn("feature", named).select(*cols)
    return g.unionByName(tx).unionByName(p)


def counts(rows: DataFrame, genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row per file: genes, transcripts, transcripts that had no parent, inferred genes, and features by their exact names."""
    original = rows.groupBy("file").agg(*[F.count_if(F.col("feature").isin(*names)).alias(k) for k, names in COUNTED.items()])
    g = genes.groupBy("file").agg(F.count("*").alias("gene_count"), F.sum("orphans").alias("orphan_transcripts_fixed"), F.count_if("inferred").alias("inferred_gene_count"))
    t = transcripts.groupBy("file").agg(F.count("*").alias("transcript_count"))
    return original.join(g, "file", "left").join(t, "file", "left").select("file", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gene_count", "transcript_count", "orphan_transcripts_fixed", "inferred_gene_count", *COUNTED)])
