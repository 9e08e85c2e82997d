"""Readers: GFF3 and GTF, splice junctions, FASTA, tables, evidence directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.operators import islands

#: Features that become models and their parts, and the codes of aligned junctions.
MODELS, HITS, PARTS = ("mrna", "transcript", "rna"), ("mRNA", "match", "protein_match", "cDNA_match"), ("CDS", "match_part", "HSP")
STRANDS = (".", "+", "-")
MOTIFS = ("non-canonical", "GT/AG", "CT/AC", "GC/AG", "CT/GC", "AT/AC", "GT/AT")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and an order that agrees with the place in each file; gzip is read too."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row_idx"), F.col("value").alias("line"))


def gff_rows(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of nine columns from lines (row_idx, line): bounds may be decimals, reversed ones are swapped.

    With `strict`, all lines but comments stay and `reject` names what is wrong: columns, bounds or order. Null lines,
    comments and blank lines never count.
    """
    c = F.split("line", "\t")
    number = lambda i: F.try_element_at(c, F.lit(i)).try_cast("double").try_cast("long")
    raw = df.filter("line is not null and trim(line) <> '' and not startswith(line, '#')").select(
        *[x for x in df.columns if x != "line"], F.size(c).alias("__n"), *[F.try_element_at(c, F.lit(i)).alias(n) for i, n in ((1, "seqid"), (2, "source"), (3, "feature"))],
        number(4).alias("__a"), number(5).alias("__b"), *[F.try_element_at(c, F.lit(i)).alias(n) for i, n in ((6, "score"), (7, "strand"), (8, "phase"), (9, "attributes"))],
    )
    if strict:
        why = F.when(F.col("__n") != 9, "columns").when(F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") < 1), "bounds").when(F.col("__b") < F.col("__a"), "order")
        return raw.withColumn("reject", why).withColumnsRenamed({"__a": "start", "__b": "end"}).drop("__n")
    good = raw.filter("__n >= 9 and __a is not null and __b is not null")
    return good.withColumns({"start": F.least("__a", "__b"), "end": F.greatest("__a", "__b")}).drop("__n", "__a", "__b")


def gff_models(rows: DataFrame) -> DataFrame:
    """Transcripts with gene, span over all parts, sorted exons and coding blocks, from GFF rows.

    The order of rows doesn't matter: a gene is inferred only if no gene row has its id; a transcript without exons gets
    them from its coding blocks; of several parents the first counts.
    """
    pairs = text.attribute_pairs(F.col("attributes"))
    at = rows.withColumns({"id": text.attribute(pairs, "ID", "transcript_id"), "parent": F.element_at(F.split(text.attribute(pairs, "Parent", "transcript_id", "geneID", "gene_id"), ","), 1), "gene": text.attribute(pairs, "Parent", "geneID", "gene_id")})
    kind = F.lower("feature")
    tx = at.filter(kind.isin(*MODELS)).groupBy(F.col("id").alias("tx_id")).agg(F.min_by("gene", "row_idx").alias("gene"), F.min_by("seqid", "row_idx").alias("seqid"), F.min_by("strand", "row_idx").alias("strand"), F.min("start").alias("s"), F.max("end").alias("e"))
    block = lambda name, extra=(): F.array_sort(F.collect_set(F.when(kind == name, F.struct("start", "end", *extra))))
    parts = at.filter(kind.isin("exon", "cds")).withColumn("p", F.explode(F.split(text.attribute(pairs, "Parent", "transcript_id"), ","))).groupBy(F.col("p").alias("tx_id")).agg(
        block("exon").alias("exons"), block("cds", ("phase",)).alias("cds"), F.min("start").alias("ps"), F.max("end").alias("pe"), F.min_by("seqid", "row_idx").alias("pseqid"), F.min_by("strand", "row_idx").alias("pstrand"),
    )
    genes = at.filter(kind == "gene").select(F.col("id").alias("gene_id")).distinct().withColumn("listed", F.lit(True))
    bare = F.transform("cds", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    both = tx.join(parts, "tx_id", "full_outer").select(
        "tx_id", F.coalesce("gene", text.inferred_gene(F.col("tx_id"))).alias("gene_id"), F.coalesce("seqid", "pseqid").alias("seqid"), F.coalesce("strand", "pstrand").alias("strand"),
        F.least("s", "ps").alias("start"), F.greatest("e", "pe").alias("end"), F.when(F.size("exons") > 0, F.col("exons")).otherwise(bare).alias("exons"), "cds",
    )
    return both.join(genes, "gene_id", "left").withColumn("gene_inferred", F.col("listed").isNull()).drop("listed")


def junctions(df: DataFrame, sample: Column) -> DataFrame:
    """Observations from lines of nine numbers by an aligner: codes of strand and motif are spelt out; reads are those that
    map once and those that map several times."""
    c = F.split("line", "\t")
    n = lambda i, kind="long": F.try_element_at(c, F.lit(i)).try_cast(kind)
    spelt = lambda i, words: F.coalesce(F.try_element_at(F.array(*map(F.lit, words)), n(i, "int") + 1), F.lit("."))
    out = df.select(c[0].alias("seqid"), n(2).alias("start"), n(3).alias("end"), spelt(4, STRANDS).alias("strand"), spelt(5, MOTIFS).alias("motif"), sample.alias("sample"), (n(7) + F.coalesce(n(8), F.lit(0))).alias("reads"), n(9).alias("hang"))
    return out.filter("start is not null and `end` is not null and reads is not null")


def table(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A tab-separated table with a header, all text; `aliases` gives a name the first non-empty of several columns."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"')
    for name, columns in (aliases or {}).items():
        found = [F.nullif(F.col(c), F.lit("")) for c in columns if c in df.columns]
        df = df.withColumn(name, F.coalesce(*found) if found else F.lit(None).cast("string"))
    return df


def last_of_key(df: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """Of rows that share a key, the last."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def fasta(df: DataFrame, width: int = islands.BIN) -> DataFrame:
    """seqid, chunk_no, start, seq: the lines of each sequence as chunks, upper-cased, with their place.

    Headers are carried forward, and lengths summed up, in bins of lines that hand on to the next ones: a huge file, and a huge
    sequence, are the work of many tasks, and a sequence is never one value. Lines before the first header, blank lines and
    sequences without a line give no row.
    """
    head = F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S*)", 1))
    named = islands.forward_fill(df.withColumn("seqid", head), ["file"], "row_idx", "seqid", width).filter("not startswith(line, '>') and trim(line) <> '' and seqid is not null")
    chunks = named.select("file", "seqid", "row_idx", F.upper(F.trim("line")).alias("seq"))
    placed = islands.running(chunks, ["file", "seqid"], "row_idx", {"before": F.length("seq"), "k": F.lit(1)}, width)
    return placed.select("seqid", (F.col("k") + 1).cast("int").alias("chunk_no"), (F.col("before") + 1).alias("start"), "seq")


def slices(chunks: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Sequence of intervals (key, seqid, start, end) put together from the chunks that they touch; null where any is missing."""
    from locuskit.operators.range_join import overlap_join

    c = chunks.select("seqid", "start", (F.col("start") + F.length("seq") - 1).alias("end"), "seq")
    p = overlap_join(places.select(key, "seqid", "start", "end"), c, ["seqid"])
    low, high = F.greatest("start", "start_r"), F.least("end", "end_r")
    part = F.struct(low.alias("at"), F.substr("seq_r", (low - F.col("start_r") + 1).cast("int"), (high - low + 1).cast("int")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "")
    return p.groupBy(key, "start", "end").agg(whole.alias("seq")).withColumn("seq", F.when(F.length("seq") == F.col("end") - F.col("start") + 1, F.col("seq")))


def protein_hits(rows: DataFrame, label: str, width: int = islands.BIN) -> DataFrame:
    """Hits with the span of their parts: hit_id (label|ID), seqid, strand, start, end, parts.

    A part belongs to its Parent; one without Parent to the hit before it on the sequence in the file, which bins of lines
    hand on.
    """
    pairs = text.attribute_pairs(F.col("attributes"))
    at = rows.withColumns({"id": text.attribute(pairs, "ID"), "parent": text.attribute(pairs, "Parent")})
    hit = F.col("feature").isin(*HITS)
    held = islands.forward_fill(at.withColumn("hit", F.when(hit, F.col("id"))), [*[c for c in ("file",) if c in rows.columns], "seqid"], "row_idx", "hit", width)
    owner = held.withColumn("hit", F.when(hit, F.col("id")).otherwise(F.coalesce("parent", "hit"))).filter(F.col("feature").isin(*HITS, *PARTS) & F.col("hit").isNotNull())
    return owner.groupBy(F.concat(F.lit(f"{label}|"), "hit").alias("hit_id")).agg(
        F.min_by("seqid", "row_idx").alias("seqid"), F.min_by("strand", "row_idx").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("feature").isin(*PARTS)).alias("parts"),
    )


def decisions(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines of decision files; of several records of a card the last valid one stays, or the last."""
    df = spark.read.schema(schema).json(path).withColumn("row_idx", F.monotonically_increasing_id())
    rank = F.struct(F.size(F.coalesce("validation_errors", F.array())) == 0, F.col("row_idx"))
    return df.groupBy("card_id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("card_id", "row_idx")]), rank).alias("d")).select("card_id", "d.*")


def records_of(spark: SparkSession, path: str | list[str], schema: str, keys: DataFrame, key: str) -> DataFrame:
    """JSON lines whose key is among `keys`; only the columns of the schema are parsed. Lines that are no JSON are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).join(keys.select(key).distinct(), key, "left_semi")


def evidence_kind(columns: list[str]) -> str | None:
    """What a table holds, by its header."""
    have = set(columns)
    if {"support_class"} <= have:
        return "long_read_models"
    if {"support_level"} <= have:
        return "long_read_sets"
    if {"n_model_junctions"} <= have:
        return "junction_support"
    if have & {"intron_start_1based", "intron_start"}:
        return "junctions"
    return "validation" if "validation_status" in have else None
