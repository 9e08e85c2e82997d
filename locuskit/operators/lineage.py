"""One-to-one lineage between current and proposed genes of a locus, and transcript identifiers; `allocation` has gene numbers.

Spark groups by locus; the assignment inside one of these small groups is a few lines of Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import intervals, text
from locuskit.operators.allocation import gap_numbers, gene_mapping, namespaces, nearest_free, parsed, positional_ids, style_ids  # noqa: F401

#: What a pair scores that no row has: other sequence or strand.
APART = (0, 0, 0, 0, -(10**18))


def heaviest(weights: list[list[int]]) -> list[int]:
    """The column of each row in the assignment of greatest summed weight; at least as many columns as rows. Shortest
    augmenting paths, over whole numbers of any size."""
    rows, cols = len(weights), len(weights[0]) if weights else 0
    u, v, taken = [0] * (rows + 1), [0] * (cols + 1), [0] * (cols + 1)
    for row in range(1, rows + 1):
        taken[0], at = row, 0
        least: list[int | None] = [None] * (cols + 1)
        way, seen = [0] * (cols + 1), [False] * (cols + 1)
        while taken[at]:
            seen[at] = True
            i, step, to = taken[at], None, 0
            for j in range(1, cols + 1):
                if not seen[j]:
                    slack = -weights[i - 1][j - 1] - u[i] - v[j]
                    if least[j] is None or slack < least[j]:
                        least[j], way[j] = slack, at
                    if step is None or least[j] < step:
                        step, to = least[j], j
            for j in range(cols + 1):
                if seen[j]:
                    u[taken[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = to
        while at:
            taken[at] = taken[way[at]]
            at = way[at]
    out = [0] * rows
    for j in range(1, cols + 1):
        if taken[j]:
            out[taken[j] - 1] = j - 1
    return out


def best_pairs(scores: dict[tuple[str, str], tuple], places: dict[tuple[str, str], int] | None = None) -> list[tuple[str, str]]:
    """The one-to-one assignment of greatest summed score vector, compared entry by entry: (old, new) pairs.

    Each gene of the smaller side gets a partner, even one that scores nothing. Of equal sums the first in order stays: genes
    go by place ((side, id) -> start; side "old" or "new"), then id, and the smaller side (new, if equal) chooses in turn.
    """
    places = places or {}
    olds, news = (sorted({p[k] for p in scores}, key=lambda g, s=side: (places.get((s, g), 0), g)) for k, side in enumerate(("old", "new")))
    few, many = (news, olds) if len(news) <= len(olds) else (olds, news)
    score = lambda x, y: scores.get((y, x) if few is news else (x, y), APART)
    # A vector becomes the digits of one number, in a base that no sum reaches, so that sums compare as the vectors do; the
    # last digits prefer earlier partners, the first gene's most.
    base = 2 * len(few) * max(abs(v) for x in few for y in many for v in score(x, y)) + 1 if few else 1
    turns, weights = len(many) + 1, []
    for i, x in enumerate(few):
        row = []
        for j, y in enumerate(many):
            n = 0
            for v in score(x, y):
                n = n * base + v
            row.append(n * turns ** len(few) + (len(many) - j) * turns ** (len(few) - 1 - i))
        weights.append(row)
    chosen = [(x, many[j]) for x, j in zip(few, heaviest(weights), strict=True)]
    return sorted((y, x) if few is news else (x, y) for x, y in chosen)


def structural_scores(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Each old model (by, id, start, end, coding) of a locus against each new one: old_id, new_id, old_at, new_at and the vector
    cds_bp, exact, ppm, span, near. Coding positions in common, equal coding blocks, the jaccard index of coding positions by the
    million, positions of the spans in common, and the distance of their middles as a negative number."""
    side = lambda df, s: df.select(by, *[F.col(c).alias(f"{s}_{c}") for c in ("id", "start", "end", "coding")])
    p = side(old, "old").join(side(new, "new"), by)
    bp = intervals.set_overlap(F.col("old_coding"), F.col("new_coding"))
    union = intervals.length(F.col("old_coding")) + intervals.length(F.col("new_coding")) - bp
    middle = lambda s: F.floor((F.col(f"{s}_start") + F.col(f"{s}_end")) / 2)
    return p.select(
        by, "old_id", "new_id", F.col("old_start").alias("old_at"), F.col("new_start").alias("new_at"), bp.alias("cds_bp"), F.size(F.array_intersect("old_coding", "new_coding")).cast("long").alias("exact"),
        F.coalesce(F.floor(bp * 1_000_000 / F.nullif(union, F.lit(0))), F.lit(0)).cast("long").alias("ppm"), intervals.overlap(F.col("old_start"), F.col("old_end"), F.col("new_start"), F.col("new_end")).alias("span"), (-F.abs(middle("old") - middle("new"))).cast("long").alias("near"),
    )


def assign(scores: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Assigned pairs (`by`, old_id, new_id) from rows (`by`, old_id, new_id, old_at, new_at, score columns).

    The rows of a locus, a few by nature, become one array; Python then takes many loci at a time in Arrow batches. The work
    in a locus grows with the cube of its genes, at every size.
    """
    grouped = scores.groupBy(by).agg(F.collect_list(F.struct("old_id", "new_id", "old_at", "new_at", *columns)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, rows in zip(pdf[by], pdf["rows"], strict=True):
                places = {("old", r["old_id"]): r["old_at"] for r in rows} | {("new", r["new_id"]): r["new_at"] for r in rows}
                out += [(key, o, n) for o, n in best_pairs({(r["old_id"], r["new_id"]): tuple(int(r[c]) for c in columns) for r in rows}, places)]
            yield pd.DataFrame(out, columns=[by, "old_id", "new_id"])

    return grouped.mapInPandas(run, f"{by} {scores.schema[by].dataType.simpleString()}, old_id string, new_id string")


def anchor_status(relation: Column, cds_bp: Column, span: Column) -> tuple[Column, Column]:
    """(basis, status) of an inherited identifier."""
    kind = F.replace(relation, F.lit("_replacement"), F.lit(""))
    basis = F.when(relation == "one_to_one_replacement", "one_to_one_lineage").when(cds_bp > 0, F.concat(kind, F.lit("_maximum_cds_contribution"))).when(span > 0, F.concat(kind, F.lit("_maximum_span_fallback"))).otherwise(F.concat(kind, F.lit("_genomic_order_fallback")))
    status = F.when(relation == "one_to_one_replacement", "deterministic_one_to_one_inheritance").when(cds_bp > 0, "deterministic_cds_anchor").when(span > 0, "deterministic_span_fallback").otherwise("deterministic_order_fallback")
    return basis, status


def transcript_mapping(rows: DataFrame, existing: DataFrame, current_style: bool = False, template: tuple[str, int] = (".t", 2)) -> DataFrame:
    """Final transcript identifiers for rows (gene_id, tx_id, start): `final_id` numbers a gene's transcripts by start, then id.

    The current style makes T of the G before the gene's number, `.1` and so on behind it. `collides` marks an identifier that
    exists (tx_id of `existing`) or was given twice.
    """
    one = rows.groupBy("gene_id", "tx_id").agg(F.min("start").alias("start"))
    k = F.row_number().over(W.partitionBy("gene_id").orderBy("start", "tx_id"))
    made = one.withColumn("k", k)
    if current_style:
        name = F.when(F.regexp_like("gene_id", F.lit(r"G\d+$")), F.concat(text.transcript_of(F.col("gene_id")), F.lit("."), F.col("k").cast("string")))
    else:
        name = F.concat("gene_id", text.numbered_id(template[0], F.col("k"), template[1]))
    made = made.withColumn("final_id", name)
    twice = made.groupBy("final_id").agg((F.count("*") > 1).alias("twice"))
    known = existing.select(F.col("tx_id").alias("final_id")).distinct().withColumn("exists", F.lit(True))
    return made.join(twice, "final_id", "left").join(known, "final_id", "left").select("gene_id", "tx_id", "final_id", (F.coalesce("twice", F.lit(False)) | F.coalesce("exists", F.lit(False))).alias("collides"))
