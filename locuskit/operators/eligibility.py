"""Audit of coding models: what makes one ineligible, and what is only a warning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.functions import intervals, rules, sequence
from locuskit.sources import readers


def audited(models: DataFrame, seq: str = "seq") -> DataFrame:
    """Models (strand, blocks, coding, declared phases or null, `seq` the sequence of their seqid or null) with `hard`,
    `warnings`, `status` and `eligible`.

    The expected phase follows from the running coding length in transcript order. Sequence checks are left out where the
    sequence is missing, which is a reason of its own.
    """
    strand, blocks, coding = F.col("strand"), F.coalesce(F.col("blocks"), F.array().cast(models.schema["blocks"].dataType)), F.coalesce(F.col("coding"), F.array().cast(models.schema["coding"].dataType))
    have, whole = F.col(seq).isNotNull(), F.col("__cds")
    n = intervals.length(coding)
    coding_some = F.size(coding) > 0
    beyond = F.exists(blocks, lambda b: (b["start"] < 1) | (b["end"] > F.length(F.col(seq))))
    gaps = F.col("__gaps")
    odd_motifs = F.size(F.filter(gaps, lambda g: ~F.coalesce(sequence.canonical(sequence.motif(F.col(seq), g["start"], g["end"], strand)), F.lit(False))))
    out = models.withColumn("__gaps", intervals.proper_introns(intervals.ordered(blocks))).withColumn("__cds", F.when(have & coding_some, sequence.spliced(F.col(seq), coding, strand)))
    expected = intervals.phases(coding, strand)
    wrong_phase = F.col("phases").isNotNull() & F.exists(F.zip_with(F.col("phases"), expected, lambda a, b: F.coalesce(a != b, F.lit(True))), lambda x: x)
    usable = F.coalesce(F.length(whole), F.lit(0)) > 0
    hard = rules.tags(
        (~have, "seqid_not_found_in_genome"), (have & beyond, "transcript_coordinates_out_of_bounds"), (~strand.isin("+", "-"), "invalid_or_missing_strand"), (F.size(blocks) == 0, "no_exon_features"), (~coding_some, "no_CDS_features"),
        (coding_some & ~intervals.nested(coding, blocks), "CDS_not_nested_within_exon"), (have & coding_some & ~usable, "CDS_sequence_unavailable_or_out_of_bounds"), (coding_some & (n % 3 != 0), "CDS_length_mod3_invalid"),
        (usable & sequence.has_inner_stop(whole), "internal_stop_present"), (wrong_phase, "phase_inconsistent"),
    )
    warn = rules.tags((usable & ~sequence.begins_with_start(whole), "missing_start_codon"), (usable & ~sequence.ends_in_stop(whole), "missing_stop_codon"), (have & ~beyond & (odd_motifs > 0), "noncanonical_splice"))
    out = out.withColumns({"hard": hard, "warnings": warn}).drop("__cds", "__gaps")
    return out.withColumns({"status": F.when(F.size("hard") > 0, "fail").when(F.size("warnings") > 0, "warning").otherwise("pass"), "eligible": F.size("hard") == 0})


def audited_on(models: DataFrame, chunks: DataFrame, key: str = "tx_id") -> DataFrame:
    """As `audited`, for models (key, seqid, start, end, strand, blocks, coding, phases) and sequences in chunks (readers.fasta).

    Each model gets the sequence of its own span only, and is judged in places counted from its start.
    """
    cut = readers.slices(chunks, models, key).select(key, "seq")
    known = chunks.select("seqid").distinct().withColumn("__known", F.lit(True))
    moved = lambda c: F.transform(c, lambda b: F.struct((b["start"] - F.col("start") + 1).alias("start"), (b["end"] - F.col("start") + 1).alias("end")))
    # A span that isn't wholly there, on a sequence that is, reaches beyond its end.
    near = models.select(key, "seqid", "strand", moved(F.col("blocks")).alias("blocks"), moved(F.col("coding")).alias("coding"), "phases").join(cut, key, "left").join(known, "seqid", "left")
    return audited(near.withColumn("seq", F.coalesce("seq", F.when(F.col("__known"), F.lit(""))))).select(key, "hard", "warnings", "status", "eligible")


def with_conflicts(audit: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """Neighbour conflicts (a, b, bp) added to both models' hard reasons."""
    both = conflicts.select(F.col("a").alias(key), F.col("b").alias("other"), "bp").union(conflicts.select("b", "a", "bp"))
    told = both.groupBy(key).agg(F.array_sort(F.collect_set(F.concat(F.lit("same_source_different_gene_high_overlap:"), F.col("other").cast("string"), F.lit(":overlap_bp_"), F.col("bp").cast("string")))).alias("__more"))
    joined = audit.join(told, key, "left").withColumn("hard", F.array_sort(F.array_union("hard", F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")
    return joined.withColumns({"eligible": F.size("hard") == 0, "status": F.when(F.size("hard") > 0, "fail").otherwise(F.col("status"))})
