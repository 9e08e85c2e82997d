"""Writers: GFF3, GTF, tables, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.functions.rules import EVIDENCE

#: Transcript features in lower case; attributes that a released feature keeps, in their order; the rank of
#: features at one place.
TRANSCRIPTS = ("mrna", "transcript", "rna", "lnc_rna", "ncrna", "rrna", "trna", "mirna", "snrna", "snorna", "pre_mirna", "primary_transcript")
KEPT = {"gene": ("ID", "Name", "biotype"), "tx": ("ID", "Parent", "Name", "biotype"), "cds": ("ID", "Parent", "protein_id"), "part": ("ID", "Parent")}
RANKS = {
    "gene": 0, "mrna": 1, "transcript": 1, "rna": 1, "lnc_rna": 1, "ncrna": 1, "rrna": 1, "trna": 1, "mirna": 1, "snrna": 1, "snorna": 1, "exon": 2, "five_prime_utr": 3, "three_prime_utr": 3, "utr": 3, "cds": 4, "start_codon": 5, "stop_codon": 5,
}


def gff_line(attributes: Column, source: Column | None = None) -> Column:
    """Nine columns as a line; nulls are written as a dot."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    return F.concat_ws("\t", *[dot(F.col(c)) for c in ("seqid",)], dot(F.col("source") if source is None else source), *[dot(F.col(c)) for c in ("feature", "start", "end", "score", "strand", "phase")], F.coalesce(attributes, F.lit(".")))


def feature_class(feature: Column) -> Column:
    f = F.lower(feature)
    return F.when(f == "gene", "gene").when(f.isin(*TRANSCRIPTS), "tx").when(f == "cds", "cds").otherwise("part")


def clean_attributes(pairs: Column, feature: Column) -> Column:
    """What the class of the feature keeps, in the order of KEPT, of repeated keys the last; empty values go.

    A gene or transcript without `biotype` takes it from `gene_biotype` or `transcript_biotype`; a Name that is the ID, once
    both are decoded, goes.
    """
    last = lambda k: F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"]
    value = lambda k: F.nullif(last(k), F.lit(""))
    kind = feature_class(feature)
    biotype = F.coalesce(value("biotype"), F.when(kind == "gene", value("gene_biotype")).when(kind == "tx", value("transcript_biotype")))
    name = F.when(text.decoded(value("Name")).eqNullSafe(text.decoded(F.coalesce(value("ID"), F.lit("")))), None).otherwise(value("Name"))
    of = lambda k: F.struct(F.lit(k).alias("k"), {"biotype": biotype, "Name": name}.get(k, value(k)).alias("v"))
    own = F.coalesce(*[F.when(kind == c, F.array(*map(of, KEPT[c]))) for c in KEPT])
    return F.filter(own, lambda p: p["v"].isNotNull())


def gtf_line(gene: Column, tx: Column) -> Column:
    quoted = lambda k, v: F.concat(F.lit(f'{k} "'), F.replace(v, F.lit('"'), F.lit("'")), F.lit('";'))
    return gff_line(F.concat_ws(" ", quoted("gene_id", gene), quoted("transcript_id", tx)))


def feature_rank(feature: Column) -> Column:
    """Place of a feature among others that start together; unknown ones are last."""
    by_name = F.create_map(*[F.lit(x) for k, v in RANKS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(by_name, F.lower(feature)), F.lit(9))


def in_order(df: DataFrame) -> DataFrame:
    """Features by sequence (numbers by value), start, rank of the feature, end, and the order they came in."""
    return df.orderBy(text.natural_key(F.col("seqid")), "start", feature_rank(F.col("feature")), "end", *[c for c in ("row_idx",) if c in df.columns])


def write_lines(df: DataFrame, line: Column, path: str, header: str | None = None, one_file: bool = False) -> None:
    """Text lines in the present order. `one_file` is for files that a person reads: it moves all rows to one task."""
    out = df.select(line.alias("value"))
    if header:
        out = df.sparkSession.createDataFrame([(header,)], "value string").union(out)
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str, fields: list[str], one_file: bool = False, compressed: bool = False) -> None:
    """Tab-separated with a header and just these columns; missing ones are empty, nulls too. `compressed` files are gzip without
    a time in them, so that equal rows in equal parts are equal bytes."""
    out = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", compression="gzip" if compressed else "none")


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("append" if append else "errorifexists").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of each file of an output."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def renamed(rows: DataFrame, mapping: DataFrame, provenance: str = "original_id") -> DataFrame:
    """Rows (row_idx, attributes, ...) with their ID and parents under final names, from a mapping (old_id, final_id).

    Both are joins on identifiers; a row's parents keep their order, and what the mapping doesn't name stays.
    """
    pairs = text.attribute_pairs(F.col("attributes"))
    at = rows.withColumns({"__id": text.attribute(pairs, "ID"), "__parents": F.split(F.coalesce(text.attribute(pairs, "Parent"), F.lit("")), ",")})
    own = mapping.select(F.col("old_id").alias("__id"), F.col("final_id").alias("__new"))
    up = at.select("row_idx", F.posexplode("__parents").alias("pos", "old_id")).filter("old_id <> ''").join(mapping, "old_id", "left")
    up = up.groupBy("row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("final_id", "old_id").alias("p")))), lambda x: x["p"]), ",").alias("__up"))
    both = at.join(own, "__id", "left").join(up, "row_idx", "left")
    swapped = F.transform(text.swapped_id(pairs, F.col("__new"), provenance), lambda p: F.struct(p["k"].alias("k"), F.when((p["k"] == "Parent") & F.col("__up").isNotNull(), F.col("__up")).otherwise(p["v"]).alias("v")))
    return both.withColumn("attributes", text.attribute_text(swapped)).select(rows.columns)


def review_card(locus: Column, region: Column, question: Column, sets: Column) -> Column:
    """A card as Markdown: a heading, where it is, what it turns on, and a table of its sets (array of set_id, sources,
    interpretation, evidence)."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))
    row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", cell(x["set_id"]), cell(F.array_join(x["sources"], ", ")), cell(x["interpretation"]), *[cell(x["evidence"][f]) for f in EVIDENCE]), F.lit(" |"))
    head = "| set | sources | interpretation | " + " | ".join(EVIDENCE) + " |\n|" + "-|" * (3 + len(EVIDENCE)) + "\n"
    return F.concat(F.lit("# "), locus, F.lit("\n\nRegion: "), region, F.lit("\n\nQuestion: "), question, F.lit("\n\n" + head), F.array_join(F.transform(F.array_sort(sets), row), "\n"), F.lit("\n"))
