"""Splice junctions, protein hits and structural edges of gene models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, numbers
from locuskit.functions.rules import compatible, junction_status
from locuskit.operators.range_join import overlap_join, self_overlaps
from locuskit.session import written

#: Positions within which a boundary agrees, and within which a junction is near.
BOUNDARY, NEARBY, LEAST_READS, LEAST_SAMPLES, LEAST_SHARE = 30, 500, 3, 1, 0.2
#: Edges that are no strong sign of one place.
MODERATE = ("span_overlap", "shared_splice_site", "terminal_boundary_difference_only")
JUNCTION = ["seqid", "start", "end", "strand"]


def merged_junctions(observed: DataFrame) -> DataFrame:
    """Observations (JUNCTION, sample, reads, hang) as one row per junction: reads, hang, samples, names."""
    return observed.groupBy(*JUNCTION).agg(F.sum("reads").alias("reads"), F.max("hang").alias("hang"), F.count_distinct("sample").alias("samples"), F.array_join(F.array_sort(F.collect_set("sample")), ",").alias("names"))


def supported(junctions: DataFrame, reads: int = LEAST_READS, samples: int = LEAST_SAMPLES) -> DataFrame:
    return junctions.filter((F.col("reads") >= reads) & (F.col("samples") >= samples) & (F.col("start") < F.col("end")))


def _strands(strand: Column) -> Column:
    """Junction strands that an intron of this strand accepts."""
    return F.when(strand == ".", F.array(F.lit("+"), F.lit("-"), F.lit("."))).otherwise(F.array(strand, F.lit(".")))


def exactly_supported(introns: DataFrame, junctions: DataFrame) -> DataFrame:
    """Introns with `exact`, `donor`, `acceptor`: junctions with both, the first, the last position. Equi joins on the
    distinct accepted strands, so a hot position costs one key."""
    at = introns.withColumn("__strand", F.explode(_strands(F.col("strand"))))
    side = lambda cols, name: junctions.select("seqid", F.col("strand").alias("__strand"), *cols).distinct().withColumn(name, F.lit(1))
    both = at.join(side(["start", "end"], "__x"), ["seqid", "__strand", "start", "end"], "left").join(side(["start"], "__d"), ["seqid", "__strand", "start"], "left").join(side(["end"], "__a"), ["seqid", "__strand", "end"], "left")
    flag = lambda c: F.coalesce(F.max(c), F.lit(0)) > 0
    return both.groupBy(*introns.columns).agg(flag("__x").alias("exact"), flag("__d").alias("donor"), flag("__a").alias("acceptor"))


def nearby(introns: DataFrame, junctions: DataFrame, window: int = NEARBY) -> DataFrame:
    """Pairs of intron and other junction on an accepted strand that share a position or lie at most `window` apart."""
    right = junctions.select(*JUNCTION, "reads", "samples")
    pairs = overlap_join(introns, right, ["seqid"], widen=window)
    return pairs.filter(((F.col("strand") == ".") | F.col("strand_r").isin(".") | (F.col("strand") == F.col("strand_r"))) & ~((F.col("start") == F.col("start_r")) & (F.col("end") == F.col("end_r"))))


def listed_near(introns: DataFrame, junctions: DataFrame, window: int = NEARBY, most: int = 20) -> DataFrame:
    """The first `most` junctions, as text, whose first or last position is within the window of the intron's."""
    near = nearby(introns, junctions, window).filter((F.abs(F.col("start_r") - F.col("start")) <= window) | (F.abs(F.col("end_r") - F.col("end")) <= window))
    one = near.select(*introns.columns, F.format_string("%s:%d-%d:%s", "seqid", "start_r", "end_r", "strand_r").alias("__shown")).distinct()
    # A row number with a limit is cut before the shuffle too, so that no list grows with a crowded place.
    first = one.withColumn("__k", F.row_number().over(W.partitionBy(*introns.columns).orderBy("__shown"))).filter(F.col("__k") <= most)
    return first.groupBy(*introns.columns).agg(F.array_join(F.array_sort(F.collect_list("__shown")), ";").alias("near"))


def model_support(introns: DataFrame, junctions: DataFrame, key: list[str]) -> DataFrame:
    """Per model: introns, supported ones, ends supported, full chain, unsupported ones as text."""
    found = exactly_supported(introns, junctions)
    lost = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("exact"), F.struct("start", "end")))), lambda b: F.concat(b["start"].cast("string"), F.lit("-"), b["end"].cast("string"))), ";")
    return found.groupBy(*key).agg(
        F.count("*").alias("introns"), F.count_if("exact").alias("supported"), F.bool_and("donor").alias("donor_supported"), F.bool_and("acceptor").alias("acceptor_supported"),
        F.bool_and("exact").alias("full_chain"), lost.alias("unsupported"),
    )


def arbitration_status(models: DataFrame, introns: DataFrame, junctions: DataFrame, key: str, window: int = NEARBY, boundary: int = BOUNDARY, first: int = 5) -> DataFrame:
    """Per model (also those without introns): introns, exact, conflicting, nearby alternatives, status.

    An unsupported intron conflicts if, of the `first` best nearby junctions, any is another one; it is an alternative if
    not both of its ends are within `boundary`.
    """
    # Both are read several times by the range join: once computed, they are tables.
    junctions, _ = written(junctions.select(*JUNCTION, "reads", "samples"), "junctions")
    found, _ = written(exactly_supported(introns, junctions), "introns")
    open_ = found.filter(~F.col("exact")).select(*introns.columns)
    order = W.partitionBy(*introns.columns).orderBy(F.desc("samples_r"), F.desc("reads_r"), "start_r", "end_r", "strand_r")
    best = nearby(open_, junctions, window).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= first)
    close = (F.abs(F.col("start_r") - F.col("start")) <= boundary) & (F.abs(F.col("end_r") - F.col("end")) <= boundary)
    other = best.groupBy(*introns.columns).agg(F.count_if(~close).alias("alternatives"))
    per = other.groupBy(key).agg(F.count("*").alias("conflicting"), F.sum("alternatives").alias("alternatives"))
    counted = found.groupBy(key).agg(F.count("*").alias("introns"), F.count_if("exact").alias("exact"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    all_ = models.select(key).join(counted, key, "left").join(per, key, "left").select(key, zero("introns"), zero("exact"), zero("conflicting"), zero("alternatives"))
    return all_.withColumn("status", junction_status(F.col("introns"), F.col("exact"), F.col("conflicting")))


def protein_support(models: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Per model with hits: their number, and the best by shared positions, then id."""
    pairs = overlap_join(models.select(key, "seqid", "strand", "start", "end"), hits, ["seqid"])
    bp = intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    return pairs.groupBy(key).agg(F.count("*").alias("hits"), F.min(F.struct((-bp).alias("bp"), F.col("hit_id_r"))).alias("b")).select(key, "hits", F.col("b.hit_id_r").alias("best_hit"), (-F.col("b.bp")).alias("best_bp"))


def _structural(models: DataFrame, key: str, least: float, told: bool) -> DataFrame:
    """Edges a < b between overlapping models of compatible strands: kind, and where `told` strength and detail too, which are
    not worked out otherwise. `models` is a written table, since both sides of the join read it."""
    p = self_overlaps(models.select(key, "seqid", "strand", "start", "end", "blocks", "coding", "gaps"), ["seqid"], key).filter(compatible(F.col("strand"), F.col("strand_r")))
    # Shared positions are a column of their own: what holds and what is told read them once.
    p = p.withColumns({"exon_bp": intervals.set_overlap(F.col("blocks"), F.col("blocks_r")), "cds_bp": intervals.set_overlap(F.col("coding"), F.col("coding_r"))})
    bp = intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    part = lambda end, start: bp / (F.col(end) - F.col(start) + 1)
    mine, other = part("end", "start"), part("end_r", "start_r")
    a, b = F.col("gaps"), F.col("gaps_r")
    some = (F.size(a) > 0) & (F.size(b) > 0)
    same = some & (a == b)
    exon, cds = F.col("exon_bp"), F.col("cds_bp")
    sites, sites_r = intervals.sites(a), intervals.sites(b)
    holds = {
        "span_overlap": F.greatest(mine, other) >= least, "exon_overlap": exon > 0, "CDS_overlap": cds > 0, "identical_intron_chain": same, "shared_introns": some & ~same & F.arrays_overlap(a, b), "shared_splice_site": some & ~same & F.arrays_overlap(sites, sites_r),
        "terminal_boundary_difference_only": same & ((F.col("start") != F.col("start_r")) | (F.col("end") != F.col("end_r"))),
    }
    if not told:
        return p.select(F.col(key).alias("a"), F.col(f"{key}_r").alias("b"), F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in holds.items()]))).alias("kind"))
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    detail = {
        "span_overlap": say("overlap_bp=", bp, ";frac_a=", numbers.fixed_text(mine, 4), ";frac_b=", numbers.fixed_text(other, 4)), "exon_overlap": say("overlap_bp=", exon), "CDS_overlap": say("overlap_bp=", cds), "identical_intron_chain": say("intron_count=", F.size(a)),
        "shared_introns": say("shared_intron_count=", F.size(F.array_intersect(a, b))), "shared_splice_site": say("shared_site_count=", F.size(F.array_intersect(sites, sites_r))), "terminal_boundary_difference_only": F.lit("same_intron_chain_with_different_span"),
    }
    row = lambda k: F.struct(F.lit(k).alias("kind"), F.lit("moderate" if k in MODERATE else "strong").alias("strength"), detail[k].alias("detail"))
    return p.select(F.col(key).alias("a"), F.col(f"{key}_r").alias("b"), F.explode(F.array_compact(F.array(*[F.when(c, row(k)) for k, c in holds.items()]))).alias("e")).select("a", "b", "e.*")


def structural_edges(models: DataFrame, key: str = "tx_id", least: float = LEAST_SHARE) -> DataFrame:
    """Typed edges a < b between overlapping models of compatible strands: one range join, then one row per kind that holds."""
    side, _ = written(models.select(key, "seqid", "strand", "start", "end", "blocks", "coding", "gaps"), "models")
    return _structural(side, key, least, False)


def gene_edges(models: DataFrame, key: str = "tx_id") -> DataFrame:
    """Models of one gene and source, tied as a chain in order of their keys: the same components as all pairs, linear in size.
    Models without a gene or source are tied to none."""
    after = F.lead(key).over(W.partitionBy("source", "gene_id").orderBy(key))
    named = models.filter("source <> '' and gene_id <> ''")
    return named.select(F.col(key).alias("a"), after.alias("b")).filter("b is not null").withColumn("kind", F.lit("same_source_gene"))


def protein_bridges(models: DataFrame, hits: DataFrame, key: str = "tx_id", flank: int = 0) -> DataFrame:
    """Models of compatible strands tied by a hit that both overlap, whatever its strand, or come within `flank` of: a < b, the
    smallest hit of each pair.

    For each hit, models of one strand are tied as a chain in order of their keys, and the first of each strand to the first
    that has none: the components of all compatible pairs, in linear size.
    """
    met = overlap_join(models.select(key, "seqid", "strand", "start", "end"), hits.select("hit_id", "seqid", "start", "end"), ["seqid"], widen=flank)
    pairs, _ = written(met.select(F.col(key).alias("a"), "strand", F.col("hit_id_r").alias("hit_id")), "hit-models")
    chain = pairs.withColumn("b", F.lead("a").over(W.partitionBy("hit_id", "strand").orderBy("a"))).filter("b is not null").select("a", "b", "hit_id")
    firsts = pairs.groupBy("hit_id", "strand").agg(F.min("a").alias("k"))
    free = firsts.filter("strand = '.'").select("hit_id", F.col("k").alias("free"))
    across = firsts.filter("strand <> '.'").join(free, "hit_id").select(F.least("k", "free").alias("a"), F.greatest("k", "free").alias("b"), "hit_id")
    return chain.union(across).groupBy("a", "b").agg(F.min("hit_id").alias("hit_id")).withColumn("kind", F.lit("protein_bridge"))


def junction_bridges(models: DataFrame, junctions: DataFrame, key: str = "tx_id", window: int = NEARBY, boundary: int = BOUNDARY) -> DataFrame:
    """Disjoint neighbouring models that a junction joins: a is the left one. A band join, then a range join to the junctions
    that lie about the gap; the smallest (start, end) of each pair is kept, with its strand, and reads and samples if it has any."""
    side = models.select(key, "seqid", "strand", "start", "end")
    p = overlap_join(side, side, ["seqid"], widen=window + 1).filter((F.col("end") < F.col("start_r")) & compatible(F.col("strand"), F.col("strand_r")))
    gaps = p.select("seqid", F.col(key).alias("a"), F.col(f"{key}_r").alias("b"), F.col("start").alias("l0"), F.col("end").alias("l1"), F.col("start_r").alias("r0"), F.col("end_r").alias("r1"), F.col("strand").alias("s1"), F.col("strand_r").alias("s2"), F.col("end").alias("start"), F.col("start_r").alias("end"))
    gaps, _ = written(gaps, "gaps")  # the range join reads it several times
    more = [c for c in ("reads", "samples") if c in junctions.columns]
    met = overlap_join(gaps, junctions.select(*JUNCTION, *more), ["seqid"], widen=boundary)
    near = lambda at, edge, low, high: (F.abs(F.col(at) - F.col(edge)) <= boundary) | F.col(at).between(F.col(low), F.col(high))
    strand = (F.col("strand_r") == ".") | (F.col("s1") == ".") | (F.col("s2") == ".") | (F.col("strand_r") == F.col("s1")) | (F.col("strand_r") == F.col("s2"))
    good = met.filter(near("start_r", "l1", "l0", "l1") & near("end_r", "r0", "r0", "r1") & strand & (F.col("start_r") < F.col("end_r")))
    kept = good.groupBy("a", "b").agg(F.min(F.struct("start_r", "end_r", "strand_r", *[f"{c}_r" for c in more])).alias("j"))
    return kept.select("a", "b", F.col("j.start_r").alias("start"), F.col("j.end_r").alias("end"), F.lit("RNA_junction_bridge").alias("kind"), F.col("j.strand_r").alias("strand"), *[F.col(f"j.{c}_r").alias(c) for c in more])


def unit_edges(models: DataFrame, hits: DataFrame, junctions: DataFrame, key: str = "tx_id", least: float = LEAST_SHARE, flank: int = 0, window: int = NEARBY, boundary: int = BOUNDARY) -> DataFrame:
    """The edges between models as a table, one row for each pair and type: model_id_a, model_id_b (in order of their text),
    edge_type, edge_strength, seqid, strand, evidence_detail.

    Structural edges are all pairs; models of a gene, and those of a hit, are tied by edges that span them. `strand` is that of
    both models, else compatible_or_mixed; `seqid` that of the first.
    """
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    # Each is read by several range joins: once computed, they are tables.
    models, _ = written(models.select(key, "seqid", "strand", "source", "gene_id", "start", "end", "blocks", "coding", "gaps"), "edge-models")
    hits, _ = written(hits, "edge-hits")
    junctions, _ = written(junctions, "edge-junctions")
    at = models.select(F.col(key).alias("k"), "seqid", "strand", "source", "gene_id")
    target = hits.select("hit_id", F.coalesce("target", F.lit("")).alias("target")) if "target" in hits.columns else hits.select("hit_id", F.lit("").alias("target"))
    genes = gene_edges(models, key).join(at.select(F.col("k").alias("a"), "source", "gene_id"), "a").select("a", "b", "kind", F.lit("strong").alias("strength"), say("source=", F.col("source"), ";gene_id=", F.col("gene_id")).alias("detail"))
    proteins = protein_bridges(models, hits, key, flank).join(target, "hit_id").select("a", "b", "kind", F.lit("moderate").alias("strength"), say("protein_hit=", F.col("hit_id"), ";target=", F.col("target")).alias("detail"))
    joined = junction_bridges(models, junctions, key, window, boundary).join(at.select(F.col("k").alias("a"), "seqid"), "a")
    name = F.format_string("%s:%d-%d:%s", "seqid", "start", "end", "strand")
    rna = joined.select("a", "b", "kind", F.lit("strong").alias("strength"), say(name, ";support=", F.col("reads"), ";samples=", F.col("samples")).alias("detail"))
    every = _structural(models, key, least, True).union(genes).union(proteins).union(rna)
    left, right = at.select(F.col("k").alias("a"), "seqid", "strand"), at.select(F.col("k").alias("b"), F.col("strand").alias("strand_b"))
    whole = every.join(left, "a").join(right, "b")
    return whole.select(
        F.least(F.col("a").cast("string"), F.col("b").cast("string")).alias("model_id_a"), F.greatest(F.col("a").cast("string"), F.col("b").cast("string")).alias("model_id_b"), F.col("kind").alias("edge_type"), F.col("strength").alias("edge_strength"), "seqid",
        F.when(F.col("strand") == F.col("strand_b"), F.col("strand")).otherwise("compatible_or_mixed").alias("strand"), F.col("detail").alias("evidence_detail"),
    )


def neighbour_conflicts(models: DataFrame, key: str = "tx_id", threshold: float = 0.9) -> DataFrame:
    """Models of one source and strand but different genes that share at least `threshold` of either: a, b, bp."""
    p = self_overlaps(models.select(key, "source", "seqid", "strand", "gene_id", "start", "end"), ["source", "seqid", "strand"], key).filter("gene_id <> gene_id_r")
    bp = intervals.overlap(F.col("start"), F.col("end"), F.col("start_r"), F.col("end_r"))
    return p.filter((bp / (F.col("end") - F.col("start") + 1) >= threshold) | (bp / (F.col("end_r") - F.col("start_r") + 1) >= threshold)).select(F.col(key).alias("a"), F.col(f"{key}_r").alias("b"), bp.alias("bp"))
