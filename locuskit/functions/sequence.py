"""Nucleotide text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CODES, COMPLEMENTS = "ACGTRYKMSWBDHVN", "TGCAYRMKSWVHDBN"
STOPS = ("TAA", "TAG", "TGA")
MOTIFS = ("GT-AG", "GC-AG", "AT-AC")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), CODES, COMPLEMENTS))


def cut(seq: Column, start: Column, end: Column) -> Column:
    """Positions start to end, 1-based and closed; empty where they leave the sequence."""
    return F.when((start >= 1) & (end <= F.length(seq)) & (start <= end), F.substr(seq, start, end - start + 1)).otherwise("")


def spliced(seq: Column, cds: Column, strand: Column) -> Column:
    """Coding sequence in transcript order; empty where a block leaves the sequence."""
    parts = F.transform(F.array_sort(cds), lambda b: cut(seq, b["start"], b["end"]))
    whole = F.when(F.exists(parts, lambda p: p == ""), "").otherwise(F.array_join(parts, ""))
    return F.when(strand == "-", reverse_complement(whole)).otherwise(whole)


def inner_codons(cds: Column) -> Column:
    """Whole codons but the last one."""
    codons = F.regexp_extract_all(F.coalesce(cds, F.lit("")), F.lit("(?s).{3}"), F.lit(0))  # one pass: a substring each would walk from the start
    return F.slice(codons, F.lit(1), F.greatest(F.size(codons) - 1, F.lit(0)))


def has_inner_stop(cds: Column) -> Column:
    return F.exists(inner_codons(cds), lambda c: c.isin(*STOPS))


def ends_in_stop(cds: Column) -> Column:
    return F.right(cds, F.lit(3)).isin(*STOPS)


def begins_with_start(cds: Column) -> Column:
    return F.left(cds, F.lit(3)) == "ATG"


def motif(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """`GT-AG` and the like of an intron, read on its strand."""
    intron = cut(seq, start, end)
    read = F.when(strand == "-", reverse_complement(intron)).otherwise(F.upper(intron))
    return F.when(F.length(read) >= 4, F.concat(F.left(read, F.lit(2)), F.lit("-"), F.right(read, F.lit(2))))


def canonical(motif_: Column) -> Column:
    return motif_.isin(*MOTIFS)
