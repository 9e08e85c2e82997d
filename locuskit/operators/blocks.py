"""Gene blocks of a GFF as raw lines: which block a line belongs to, which blocks a policy lets into a release, and their order.

Lines are tied to their block by joins on identifiers; only narrow columns are exploded and joined, and the raw line is
joined once, by its number. Nothing is rewritten: what is chosen leaves byte for byte as it came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuskit.functions import rules, text
from locuskit.session import written

#: Features of transcripts; the rank of a feature in its block (others 5); evidence and junction states that
#: support a gene no current one covers.
TRANSCRIPTS = ("mrna", "transcript", "rna")
IN_BLOCK = {"gene": 0, "mRNA": 1, "transcript": 1, "rna": 1, "exon": 2, "CDS": 2, "five_prime_UTR": 2, "three_prime_UTR": 2, "five_prime_utr": 2, "three_prime_utr": 2}
LEVELS, JUNCTIONS = ("strong", "moderate"), ("full_junction_support", "partial_junction_support")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines (row_idx, line) of exactly nine columns, with seqid, feature, start, end, strand, phase and attributes as a map.

    Comments, empty lines and lines of other lengths are left out; of a repeated attribute the last value counts.
    """
    c = F.split("line", "\t")
    whole = lines.filter("line is not null and line <> '' and not startswith(line, '#')").filter(F.size(c) == 9)
    names = {"seqid": 0, "feature": 2, "start": 3, "end": 4, "strand": 6, "phase": 7}
    return whole.select("row_idx", "line", *[c[i].alias(n) for n, i in names.items()], text.attribute_map(text.attribute_pairs(c[8])).alias("attrs"))


def _value(name: str) -> Column:
    return F.nullif(F.try_element_at(F.col("attrs"), F.lit(name)), F.lit(""))


def _parents() -> Column:
    return F.filter(F.split(F.coalesce(_value("Parent"), F.lit("")), "[, ]+"), lambda x: x != "")


def gene_blocks(lines: DataFrame) -> DataFrame:
    """The lines (row_idx, line) that belong to a gene: `block`, `gene_id`, `ambiguous`, the parsed columns, and of the block's
    gene line `g_seqid`, `g_start`, `g_end`, `g_strand`, `g_row`, `g_line`, `g_attrs`.

    A gene line with an ID opens a block under that ID, the n-th of the same ID under `ID__duplicate_n`. Another line belongs to
    the first of its parents that is a gene or a known transcript, else to its geneID or gene_id; where several genes have the
    ID, to the first (`ambiguous`). Of several lines for a transcript the last names its gene. Lines without a gene are left out.
    """
    rows, _ = written(parsed_lines(lines), "lines")
    kind, opens = F.lower("feature"), (F.lower("feature") == "gene") & _value("ID").isNotNull()
    n = F.row_number().over(W.partitionBy("gene_id").orderBy("row_idx"))
    genes = rows.filter(opens).select("row_idx", _value("ID").alias("gene_id"), *[F.col(c).alias(f"g_{c}") for c in ("seqid", "start", "end", "strand", "line", "attrs")]).withColumn("n", n)
    genes = genes.withColumn("block", F.when(F.col("n") == 1, F.col("gene_id")).otherwise(F.concat("gene_id", F.lit("__duplicate_"), F.col("n").cast("string"))))
    names = genes.groupBy("gene_id").agg((F.count("*") > 1).alias("several"))
    parent = F.coalesce(_value("geneID"), _value("gene_id"), F.try_element_at(_parents(), F.lit(1)))
    owners = rows.filter(kind.isin(*TRANSCRIPTS)).select(_value("ID").alias("name"), parent.alias("owner"), "row_idx").filter("name is not null and owner is not null").groupBy("name").agg(F.max_by("owner", "row_idx").alias("owner"))

    direct = F.transform(F.filter(F.array(_value("geneID"), _value("gene_id")), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("name"), F.lit(True).alias("direct")))
    wanted = F.concat(F.transform(_parents(), lambda x: F.struct(x.alias("name"), F.lit(False).alias("direct"))), direct)
    asked = rows.filter(~opens).select("row_idx", F.posexplode(wanted).alias("at", "w")).select("row_idx", "at", "w.*")
    found = asked.join(names.select(F.col("gene_id").alias("name"), F.lit(True).alias("is_gene")), "name", "left").join(owners, "name", "left")
    owner = F.when(F.col("is_gene"), F.col("name")).when(~F.col("direct"), F.col("owner"))
    children = found.withColumn("gene_id", owner).filter("gene_id is not null").groupBy("row_idx").agg(F.min_by("gene_id", "at").alias("gene_id"))
    tied = children.join(names, "gene_id").select("row_idx", F.col("gene_id").alias("block"), "gene_id", F.col("several").alias("ambiguous"))
    # Narrow and read again and again: who belongs where is found once, and heads meet it before the raw lines do.
    every, _ = written(genes.select("row_idx", "block", "gene_id", F.lit(False).alias("ambiguous")).union(tied), "tied")
    heads = genes.select("block", F.col("row_idx").alias("g_row"), "g_seqid", "g_start", "g_end", "g_strand", "g_line", "g_attrs")
    return rows.join(every.join(heads, "block"), "row_idx")


def block_order(rows: DataFrame) -> DataFrame:
    """Lines in the order of a release: blocks by sequence (numbers by value), place and gene, lines of a block by rank and number.

    The sort is Spark's own range partitioning with the block's keys first, so its parts follow one another.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in IN_BLOCK.items() for x in kv]), F.col("feature")), F.lit(5))
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(10**18))
    return rows.orderBy(text.natural_key(F.col("g_seqid")), number("g_start"), number("g_end"), "gene_id", "origin", "g_row", rank, "row_idx")


def supported_by_all(needs: DataFrame, has: DataFrame, on: list[str], key: str, by: str = "source") -> DataFrame:
    """`key` and `by`: who has every item (on) that a key needs; by two counts, so no set is gathered anywhere."""
    wanted = needs.select(key, *on).distinct()
    total = wanted.groupBy(key).agg(F.count("*").alias("total"))
    met = wanted.join(has.select(*on, by).distinct(), on).groupBy(key, by).agg(F.count("*").alias("n"))
    return met.join(total, key).filter("n = total").select(key, by)


def coding_signatures(rows: DataFrame) -> DataFrame:
    """`block`, `locus_id`, `cds_signature` of each coding transcript of a block (rows of `gene_blocks`), equal ones once.

    Coding lines without a transcript of the block among their parents count together, if the block has none or they name
    the gene.
    """
    tx = rows.filter(F.lower("feature").isin(*TRANSCRIPTS)).select("block", _value("ID").alias("tx")).filter("tx is not null").distinct()
    cds = rows.filter(F.lower("feature") == "cds").select("block", "gene_id", "row_idx", "g_seqid", "g_strand", _value_of("g_attrs", "locus_id").alias("locus_id"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "phase").alias("b"), _parents().alias("parents"))
    has = tx.select("block", F.lit(True).alias("any")).distinct()
    own = cds.select("*", F.explode("parents").alias("tx")).join(tx, ["block", "tx"], "left_semi").select("block", "locus_id", "row_idx", "g_seqid", "g_strand", "tx", "b")
    bare = cds.join(own.select("row_idx").distinct(), "row_idx", "left_anti").join(has, "block", "left").filter(F.col("any").isNull() | F.array_contains("parents", F.col("gene_id"))).select("block", "locus_id", "row_idx", "g_seqid", "g_strand", F.lit(None).cast("string").alias("tx"), "b")
    sets = own.union(bare).groupBy("block", "locus_id", "g_seqid", "g_strand", "tx").agg(F.collect_set("b").alias("cds"))
    return sets.select("block", "locus_id", text.coding_signature(F.col("g_seqid"), F.col("g_strand"), F.col("cds")).alias("cds_signature")).distinct()


def _value_of(attrs: str, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(attrs), F.lit(name)), F.lit(""))


def policy_blocks(proposals: DataFrame, current: DataFrame, calls: DataFrame, records: DataFrame, models: DataFrame, support: DataFrame, policy: str) -> dict[str, DataFrame]:
    """What a policy lets out of a proposal catalogue; the genes that a refused proposal would replace come back.

    `proposals` and `current` are rows of `gene_blocks`; `calls` (locus_id, final_call, best_evidence_level,
    manual_review_unsupported_locus, member_real_sources), `models` (model_id, rna_junction_status) one row a key; `records`
    have export_gene_id and source_model_id, `support` locus_id, cds_signature, source. Gives `decisions` (block, gene_id,
    include, reason, sources), `rows` (lines of the blocks let out, with `origin` 0 from the catalogue, 1 restored) and
    `records` of the proposals let out.
    """
    at = lambda n: _value_of("g_attrs", n)
    heads = proposals.filter("row_idx = g_row").select(
        "block", "gene_id", "g_line", *[at(n).alias(n) for n in ("locus_id", "export_readiness", "final_call", "relation_to_current", "proposal_action", "proposal_catalog", "replaces_current_genes", "source_model_id")]
    )
    named = heads.select("block", F.explode(text.split_list(F.col("source_model_id"))).alias("model_id")).union(
        heads.select("block", "gene_id").join(records.select(F.col("export_gene_id").alias("gene_id"), F.explode(text.split_list(F.col("source_model_id"))).alias("model_id")), "gene_id").select("block", "model_id")
    )
    junction = named.join(models.filter(F.col("rna_junction_status").isin(*JUNCTIONS)).select("model_id"), "model_id", "left_semi").select("block", F.lit(True).alias("junction")).distinct()
    others = support.filter("lower(source) <> 'current'")
    exact = supported_by_all(coding_signatures(proposals), others, ["locus_id", "cds_signature"], "block").groupBy("block").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    call = calls.select("locus_id", F.col("final_call").alias("c_call"), "best_evidence_level", "manual_review_unsupported_locus", "member_real_sources")
    one = heads.join(junction, "block", "left").join(exact, "block", "left").join(call, "locus_id", "left")
    uncovered = (F.col("proposal_action") == "add_novel_selected_set") | (F.col("relation_to_current") == "novel_gene_candidate_no_current_overlap")
    fine = F.coalesce(F.col("best_evidence_level").isin(*LEVELS) & (F.col("manual_review_unsupported_locus") == "false"), F.lit(False))
    supported = fine & (F.coalesce(F.col("c_call") == "novel_gene_candidate_manual_review", F.lit(False)) | (uncovered if policy.startswith("strict_") else F.lit(False)))
    members = F.size(F.array_distinct(F.filter(text.split_list(F.col("member_real_sources")), lambda x: x != "current")))
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    include, reason = rules.policy(policy, F.col("export_readiness"), F.col("final_call"), F.col("relation_to_current"), supported, members, F.coalesce("junction", F.lit(False)), uncovered, F.size(sources))
    decided, _ = written(one.select("block", "gene_id", "g_line", "replaces_current_genes", (F.lower("proposal_catalog") == "true").alias("proposed"), include.alias("include"), reason.alias("reason"), sources.alias("sources")), "policy")

    back = decided.filter("not include").select(F.explode(text.split_list(F.col("replaces_current_genes"))).alias("gene_id")).distinct()
    there = decided.filter("include and not proposed").select("g_line").distinct()
    home = current.filter("row_idx = g_row").join(back, "gene_id", "left_semi").join(there, "g_line", "left_anti")
    home = home.groupBy("g_line").agg(F.min_by("block", F.struct("gene_id", "g_row")).alias("block")).select("block")  # equal lines once
    taken = proposals.join(decided.filter("include").select("block"), "block", "left_semi").withColumn("origin", F.lit(0))
    restored = current.join(home, "block", "left_semi").withColumn("origin", F.lit(1))
    out = records.join(decided.filter("include and proposed").select(F.col("gene_id").alias("export_gene_id"), F.array_join("sources", ",").alias("selected_cds_support_sources"), F.size("sources").alias("selected_cds_support_count"), F.col("reason").alias("policy_decision_reason")), "export_gene_id")
    return {"decisions": decided.drop("g_line", "replaces_current_genes"), "rows": taken.unionByName(restored), "records": out}


def policy_summary(made: dict[str, DataFrame]) -> DataFrame:
    """metric and value: blocks, transcripts, repeated gene ids, decisions by reason."""
    rows, d = made["rows"], made["decisions"]
    heads = rows.filter("row_idx = g_row")
    of = lambda df, name, value: df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        of(heads, "output_gene_blocks", F.count("*")), of(rows, "output_transcripts", F.count_if(F.lower("feature").isin(*TRANSCRIPTS))), of(heads, "duplicate_gene_ids_in_output_blocks", F.count("*") - F.count_distinct("gene_id")),
        of(heads.filter("origin = 1"), "restored_current_gene_blocks", F.count("*")), of(d.filter("include and proposed"), "included_proposal_gene_blocks", F.count_distinct("block")), of(made["records"], "policy_records", F.count("*")),
        d.groupBy(F.concat(F.lit("decision:"), "reason").alias("metric")).agg(F.count("*").alias("value")), d.filter("include and proposed").groupBy(F.concat(F.lit("included:"), "reason").alias("metric")).agg(F.count("*").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def backbone(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines (row_idx, line) of a current annotation without the genes (gene_id) that go, their transcripts and what lies below.

    A gene goes by its ID or Name, a transcript by its gene or by any parent that goes, other lines by a transcript that goes.
    Lines of fewer than nine columns stay; comments and empty lines are left out.
    """
    c = F.split("line", "\t")
    attrs = F.when(F.size(c) >= 9, text.attribute_map(text.attribute_pairs(F.get(c, F.lit(8)))))
    rows = lines.filter("line is not null and line <> '' and not startswith(line, '#')").select("row_idx", "line", F.lower(F.get(c, F.lit(2))).alias("kind"), attrs.alias("attrs"))
    ident, parents = F.coalesce(_value("ID"), _value("Name")), text.split_list(_value("Parent"))
    is_tx = F.col("kind").isin(*TRANSCRIPTS)
    gone = removed.select("gene_id").distinct()
    gone_tx = rows.filter(is_tx & F.col("attrs").isNotNull()).select(ident.alias("tx"), F.get(parents, F.lit(0)).alias("gene_id")).join(gone, "gene_id", "left_semi").select("tx").distinct()
    names = rows.filter("attrs is not null").select("row_idx", F.explode(
        F.when(F.col("kind") == "gene", F.array(F.struct(F.lit("g").alias("k"), ident.alias("name"))))
        .when(is_tx, F.concat(F.array(F.struct(F.lit("t").alias("k"), ident.alias("name"))), F.transform(parents, lambda p: F.struct(F.lit("g").alias("k"), p.alias("name")))))
        .otherwise(F.transform(parents, lambda p: F.struct(F.lit("t").alias("k"), p.alias("name"))))
    ).alias("n")).select("row_idx", "n.*")
    dead = gone.select(F.lit("g").alias("k"), F.col("gene_id").alias("name")).union(gone_tx.select(F.lit("t"), "tx"))
    return rows.join(names.join(dead, ["k", "name"], "left_semi").select("row_idx").distinct(), "row_idx", "left_anti").select("row_idx", "line")
