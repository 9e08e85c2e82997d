"""Readers of evidence: junction files of either kind, junction tables of several samples, long-read folders, summaries, gene blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.operators import hierarchy
from locuskit.sources import readers

#: Names of the two tables of a long-read folder.
BY_MODEL, BY_SET = "long_read_model_support_by_model.tsv", "long_read_set_support_by_locus.tsv"


def junction_file(lines: DataFrame, sample: Column) -> DataFrame:
    """Observations (seqid, start, end, strand, motif, sample, reads, hang) from the lines of one file: an aligner's nine columns,
    or a table with a header, told apart by the first line."""
    first = lines.orderBy("row_idx").limit(1).collect()
    head = first[0].line if first else ""
    if not (head.startswith("chrom\t") or "intron_start_1based" in head):
        return readers.junctions(lines, sample)
    at = {c: i for i, c in enumerate(head.split("\t"))}
    cells = F.split("line", "\t")
    value = lambda *names: F.coalesce(*[F.nullif(F.get(cells, F.lit(at[n])), F.lit("")) for n in names if n in at], F.lit(None).cast("string"))
    number = lambda *names: F.coalesce(value(*names).try_cast("double").try_cast("long"), F.lit(0))
    rows = lines.filter(F.col("line") != F.lit(head))
    return rows.select(
        F.coalesce(value("chrom", "seqid", "chr"), F.lit("")).alias("seqid"), number("intron_start_1based", "intron_start").alias("start"), number("intron_end_1based", "intron_end").alias("end"), F.coalesce(value("strand"), F.lit(".")).alias("strand"),
        F.coalesce(value("splice_motif"), F.lit("")).alias("motif"), sample.alias("sample"), number("junction_read_count", "support_count").alias("reads"), number("max_overhang").alias("hang"),
    )


def sample_ids(manifest: DataFrame) -> DataFrame:
    """The samples of a manifest, which must have a column sample_id."""
    if "sample_id" not in manifest.columns:
        raise ValueError("a sample manifest must have a column sample_id")
    return manifest.filter("sample_id <> ''").select("sample_id")


def junction_tables(df: DataFrame, reads: int, samples: int) -> DataFrame:
    """Junctions of several tables as one: rows below the thresholds go first, then reads add up and samples unite."""
    n = lambda c: text.whole_number(F.col(c))
    kept = df.filter((n("junction_read_count") >= reads) & (n("sample_support_count") >= samples) & (n("intron_start_1based") > 0))
    named = kept.select(F.col("chrom").alias("seqid"), n("intron_start_1based").alias("start"), n("intron_end_1based").alias("end"), F.coalesce(F.nullif("strand", F.lit("")), F.lit(".")).alias("strand"), n("junction_read_count").alias("reads"), text.split_list(F.col("supporting_samples")).alias("names"))
    return named.groupBy("seqid", "start", "end", "strand").agg(F.sum("reads").alias("reads"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")).withColumn("samples", F.size("names"))


def sources_with(spark: SparkSession, folder: str, name: str) -> list[str]:
    """The folders below `folder` that hold a table `name`, a file or the parts of one, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    below = [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]
    return sorted(p.getName() for p in below if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, name)))


def long_read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(models, genes) of a folder with a folder for each source. models: source, transcript, support, conflicts, risks; genes:
    source, gene_id, level, exact, partial, unsupported, conflicts, best, risks. The last row of a key counts."""

    def read(name: str) -> DataFrame:
        # A folder for each source, as many as a run has: columns are met by name, since their order may differ between sources.
        parts = [spark.read.csv(f"{folder.rstrip('/')}/{own}/{name}", sep="\t", header=True, inferSchema=False).withColumn("__own", F.lit(own)) for own in sources_with(spark, folder, name)]
        if not parts:
            raise FileNotFoundError(f"no {name} in the folders of {folder}")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        return whole.withColumn("row_idx", F.monotonically_increasing_id())

    def pick(df: DataFrame, c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")

    n = lambda df, c: text.whole_number(pick(df, c)).cast("long")
    source = lambda df: F.coalesce(F.nullif(pick(df, "model_set"), F.lit("")), F.col("__own"))
    m, g = read(BY_MODEL), read(BY_SET)
    models = m.select(source(m).alias("source"), pick(m, "model_id").alias("transcript"), pick(m, "support_class").alias("support"), n(m, "conflicting_chain_count").alias("conflicts"), text.split_list(pick(m, "risk_tags")).alias("risks"), "row_idx").filter("transcript <> ''")
    genes = g.select(
        source(g).alias("source"), pick(g, "locus_id").alias("gene_id"), pick(g, "support_level").alias("level"), n(g, "exact_supported_transcripts").alias("exact"), n(g, "partial_supported_transcripts").alias("partial"), n(g, "unsupported_transcripts").alias("unsupported"),
        n(g, "conflicting_chain_count").alias("conflicts"), text.split_list(pick(g, "best_supported_model_ids")).alias("best"), text.split_list(pick(g, "risk_tags")).alias("risks"), "row_idx",
    ).filter("gene_id <> ''")
    last = lambda df, *key: df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*key, "row_idx")]), "row_idx").alias("r")).select(*key, "r.*")
    return last(models, "source", "transcript"), last(genes, "source", "gene_id")


def summary_by_model(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """A validation or eligibility table by the first of its key columns that isn't empty; the last row of a key counts."""
    found = [F.nullif(F.col(c), F.lit("")) for c in ("model_id", "object_id", "candidate_id") if c in df.columns]
    return readers.last_of_key(df.withColumn("key", F.coalesce(*found)).filter("key is not null"), "key", order)


def gene_blocks(rows: DataFrame) -> DataFrame:
    """Rows (as for hierarchy, with gene_ref: geneID or gene_id) with the `block` of their gene: a gene row's own id, a
    transcript's parent, a part's transcript's; else the gene it names. Repeated genes are blocks `id__duplicate_n` of their own."""
    kind = hierarchy.kind_of(F.col("feature"))
    r = rows.withColumn("kind", kind)
    k = F.row_number().over(W.partitionBy("id").orderBy("row_idx"))
    genes = r.filter("kind = 'gene'").withColumn("k", k).withColumn("block", F.when(F.col("k") == 1, F.col("id")).otherwise(F.concat("id", F.lit("__duplicate_"), F.col("k").cast("string")))).drop("k")
    tx = r.filter("kind = 'transcript'").withColumn("block", F.coalesce(F.get("parents", F.lit(0)), "gene_ref"))
    owner = tx.groupBy("id").agg(F.max_by("block", "row_idx").alias("of"))
    first = F.get("parents", F.lit(0))
    rest = r.filter("kind in ('child', 'other')").withColumn("p", first).join(owner.withColumnRenamed("id", "p"), "p", "left").join(genes.select(F.col("block").alias("p"), F.lit(True).alias("is_gene")), "p", "left")
    rest = rest.withColumn("block", F.coalesce("of", F.when(F.col("is_gene"), F.col("p")), "gene_ref")).drop("p", "of", "is_gene")
    return genes.unionByName(tx).unionByName(rest).filter("block is not null and block <> ''")


def organelles(rows: DataFrame) -> DataFrame:
    """Sequences that region rows mark as of a chloroplast or mitochondrion, wherever these rows stand."""
    genome = F.lower(F.coalesce(text.attribute(text.attribute_pairs(F.col("attributes")), "genome"), F.lit("")))
    return rows.filter((F.lower("feature") == "region") & genome.isin("chloroplast", "mitochondrion")).select("seqid").distinct()


def header_value(lines: DataFrame, name: str) -> str | None:
    """The value of the first comment `# name: value` or `#name=value` of a file."""
    pattern = rf"^#+\s*{name}\s*[:=]\s*(.*)$"
    found = lines.filter(F.col("line").startswith("#")).select("row_idx", F.regexp_extract("line", pattern, 1).alias("v")).filter("v <> ''").orderBy("row_idx").limit(1).collect()
    return found[0].v.strip() if found else None


def included(manifest: DataFrame) -> DataFrame:
    """Rows of a source manifest whose flag `include` is true, or that have none."""
    if "include" not in manifest.columns:
        return manifest
    return manifest.filter(text.truth(F.col("include")) | (F.trim(F.coalesce("include", F.lit(""))) == ""))
