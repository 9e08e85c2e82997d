"""Contracts of evidence tables: which columns they need, and which of their rows break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.functions import text

#: Features of protein hits and of their parts, in lower case.
HITS, PARTS = ("mrna", "match", "protein_match", "cdna_match"), ("cds", "match_part", "hsp")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def junction_faults(df: DataFrame) -> DataFrame:
    """The rows of a junction table (text columns) with `fault`: numbers, coordinates, bed, counts or samples; else null.

    Start below end, both positive; BED bounds, where given, half open; a known strand, reads, at least one sample; samples
    sorted, distinct, as many as counted.
    """
    col = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    number = lambda c: F.when(F.trim(col(c)) == "", F.lit(0).cast("long")).otherwise(F.trim(col(c)).try_cast("long"))
    whole = lambda c: F.trim(col(c)).rlike(r"^[+-]?[0-9]+$") | (col(c) == "")
    start, end, reads, samples = (number(c) for c in ("intron_start_1based", "intron_end_1based", "junction_read_count", "sample_support_count"))
    listed = F.filter(F.transform(F.split(col("supporting_samples"), ","), lambda s: F.trim(s)), lambda s: s != "")
    fine = whole("intron_start_1based") & whole("intron_end_1based") & whole("junction_read_count") & whole("sample_support_count") & whole("bed_start_0based") & whole("bed_end_0based")
    bed = ((col("bed_start_0based") != "") & (number("bed_start_0based") != start - 1)) | ((col("bed_end_0based") != "") & (number("bed_end_0based") != end))
    fault = (
        F.when(~fine, "numbers").when((start <= 0) | (end <= 0) | (start >= end), "coordinates").when(bed, "bed").when(~col("strand").isin("+", "-", ".") | (reads < 0) | (samples < 1), "counts")
        .when((listed != F.array_sort(F.array_distinct(listed))) | (F.size(listed) != samples), "samples")
    )
    return df.withColumn("fault", fault)


def fraction_faults(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with `fault`: whether any of the columns is neither empty, not assessable, nor a number from 0 to 1."""
    bad = F.lit(False)
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(""))
        x = F.trim(v).try_cast("double")
        bad = bad | (~v.isin("", "not_assessable") & F.coalesce((x < 0) | (x > 1), F.lit(True)))
    return df.withColumn("fault", bad)


def protein_faults(lines: DataFrame) -> DataFrame:
    """One row of counts over lines of a protein alignment: rows, bad ones, hits, parts, hits with a target, with an identity."""
    c = F.split("line", "\t")
    feature = F.lower(F.coalesce(F.try_element_at(c, F.lit(3)), F.lit("")))
    number = lambda i: F.try_element_at(c, F.lit(i)).try_cast("double").try_cast("long")
    ours = feature.isin(*HITS, *PARTS)
    short = F.size(c) < 9
    wrong = ours & F.coalesce((number(4) <= 0) | (number(5) <= 0) | (number(4) > number(5)), F.lit(True))
    pairs = text.attribute_pairs(F.try_element_at(c, F.lit(9)))
    is_hit = ~short & feature.isin(*HITS)
    df = lines.filter("line is not null and trim(line) <> '' and not startswith(line, '#')")
    return df.agg(
        F.count("*").alias("rows"), F.count_if(short | wrong).alias("bad"), F.count_if(is_hit).alias("hits"), F.count_if(~short & feature.isin(*PARTS)).alias("parts"),
        F.count_if(is_hit & text.attribute(pairs, "Target").isNotNull()).alias("targets"), F.count_if(is_hit & text.attribute(pairs, "Identity", "identity").isNotNull()).alias("identities"),
    )
