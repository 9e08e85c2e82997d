"""Readers and writers over small files."""

import gzip

from pyspark.sql import functions as F

from locuskit.functions import text
from locuskit.sources import evidence_tables, readers, writers

GFF = """##gff-version 3
chr1\tx\tmRNA\t100\t500\t.\t+\t.\tID=t1;Parent=g1
chr1\tx\texon\t300\t500\t.\t+\t.\tParent=t1
chr1\tx\texon\t200\t100\t.\t+\t.\tParent=t1
chr1\tx\tCDS\t120\t200\t.\t+\t0\tParent=t1
chr1\tx\tgene\t100\t500\t.\t+\t.\tID=g1
chr2\tx\tCDS\t10\t20.0\t.\t-\t0\tParent=t2.t1
chr2\tx\tCDS\t30\t40\t.\t-\t0\tParent=t2.t1
broken line
"""


def test_gff_to_models(spark, tmp_path):
    with gzip.open(tmp_path / "a.gff3.gz", "wt") as f:
        f.write(GFF)
    got = {m.tx_id: m for m in readers.gff_models(readers.gff_rows(readers.lines(spark, str(tmp_path / "a.gff3.gz")))).collect()}
    assert got["t1"].exons == [(100, 200), (300, 500)] and got["t1"].gene_id == "g1" and not got["t1"].gene_inferred
    assert got["t2.t1"].exons == [(10, 20), (30, 40)] and got["t2.t1"].gene_id == "t2" and got["t2.t1"].gene_inferred
    strict = readers.gff_rows(readers.lines(spark, str(tmp_path / "a.gff3.gz")), strict=True).groupBy("reject").count().collect()
    assert {r.reject: r["count"] for r in strict} == {None: 6, "order": 1, "columns": 1}


def test_junction_lines(spark):
    df = spark.createDataFrame([("chr1\t201\t299\t1\t1\t0\t8\t2\t30",), ("chr1\t600\t699\t0\t0\t0\t5\t0\t9",), ("bad",)], "line string")
    got = readers.junctions(df, F.lit("s")).collect()
    assert [tuple(r) for r in got] == [("chr1", 201, 299, "+", "GT/AG", "s", 10, 30), ("chr1", 600, 699, ".", "non-canonical", "s", 5, 9)]


def test_fasta_slices(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a one\nACGT\nacgt\n\n>b\nTTTT\n")
    chunks = readers.fasta(readers.lines(spark, str(tmp_path / "g.fa")))
    places = spark.createDataFrame([(1, "a", 3, 6), (2, "b", 1, 4), (3, "b", 3, 9)], "k int, seqid string, start long, `end` long")
    assert {r.k: r.seq for r in readers.slices(chunks, places, "k").collect()} == {1: "GTAC", 2: "TTTT", 3: None}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "id int, chrom string, v string")
    writers.write_table(df, str(tmp_path / "t"), ["id", "chrom", "extra"])
    back = readers.table(spark, str(tmp_path / "t"), {"seqid": ("seqid", "chrom"), "none": ("absent",)})
    assert {(r.id, r.seqid, r.none) for r in back.collect()} == {("1", None, None), ("2", "b", None)}
    writers.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_protein_hits(spark):
    lines = ["chr1\tp\tmatch\t10\t20\t.\t+\t.\tID=h1", "chr1\tp\tmatch_part\t5\t8\t.\t+\t.\tParent=h1", "chr1\tp\tmatch_part\t30\t40\t.\t+\t.\tTarget=x"]
    df = spark.createDataFrame(list(enumerate(lines)), "row_idx long, line string")
    (h,) = readers.protein_hits(readers.gff_rows(df), "lab").collect()
    assert tuple(h) == ("lab|h1", "chr1", "+", 5, 40, 2)


def test_release_lines(spark):
    df = spark.createDataFrame([("chr10", "gene", 1, 9), ("chr2", "exon", 1, 4), ("chr2", "gene", 1, 9), ("chr2", "mRNA", 1, 9)], "seqid string, feature string, start int, `end` int")
    assert [(r.seqid, r.feature) for r in writers.in_order(df).collect()] == [("chr2", "gene"), ("chr2", "mRNA"), ("chr2", "exon"), ("chr10", "gene")]
    pairs = text.attribute_pairs(F.lit("ID=a;Name=a;locus=1;Parent=g"))
    assert df.limit(1).select(text.attribute_text(writers.clean_attributes(pairs, F.lit("mRNA")))).first()[0] == "ID=a;Parent=g"
    assert readers.evidence_kind(["support_class", "x"]) == "long_read_models" and readers.evidence_kind(["q"]) is None


def test_released_attributes_and_order(spark):
    """Cases of a release: what each class keeps, biotype from its older name, Name that is the ID once decoded, and ranks."""
    cases = [
        ("gene", "ID=g%20A;Name=g A;gene_biotype=protein_coding;Note=x", "ID=g%20A;biotype=protein_coding"),
        ("gene", "Name=n;ID=g1;biotype=lncRNA;gene_biotype=x", "ID=g1;Name=n;biotype=lncRNA"),
        ("lnc_RNA", "Parent=g1;ID=t1;transcript_biotype=lncRNA;selected_source=ToolA", "ID=t1;Parent=g1;biotype=lncRNA"),
        ("CDS", "protein_id=p%2B1;Parent=t1;ID=c1;Name=c", "ID=c1;Parent=t1;protein_id=p%2B1"),
        ("exon", "exon_number=1;protein_id=p;Parent=t1,t2;ID=e1", "ID=e1;Parent=t1,t2"),
    ]
    df = spark.createDataFrame(cases, "feature string, line string, want string")
    got = df.select("want", text.released_text(writers.clean_attributes(text.attribute_pairs(F.col("line")), F.col("feature"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = [("c1", "exon", 1, 9), ("c1", "CDS", 1, 5), ("c1", "five_prime_UTR", 1, 3), ("c1", "lnc_RNA", 1, 9), ("c1", "mRNA", 1, 5), ("c1", "gene", 1, 9), ("c1", "odd", 1, 1), ("c1", "stop_codon", 1, 3)]
    df = spark.createDataFrame(rows, "seqid string, feature string, start int, `end` int")
    assert [r.feature for r in writers.in_order(df).collect()] == ["gene", "mRNA", "lnc_RNA", "exon", "five_prime_UTR", "CDS", "stop_codon", "odd"]


def test_evidence_tables(spark):
    lines = lambda rows: spark.createDataFrame(list(enumerate(rows)), "row_idx long, line string")
    star = evidence_tables.junction_file(lines(["chr1\t5\t9\t2\t1\t0\t4\t3\t30", "bad"]), F.lit("s")).first()
    assert (star.seqid, star.start, star.end, star.strand, star.reads, star.hang) == ("chr1", 5, 9, "-", 7, 30)
    assert evidence_tables.junction_file(lines([]), F.lit("s")).collect() == []
    table = spark.createDataFrame([("c", "5", "9", "", "3", "1", "a"), ("c", "5", "9", ".", "4", "2", "b,a"), ("c", "5", "9", "", "1", "1", "z")], "chrom string, intron_start_1based string, intron_end_1based string, strand string, junction_read_count string, sample_support_count string, supporting_samples string")
    (j,) = evidence_tables.junction_tables(table, 2, 1).collect()
    assert (j.strand, j.reads, j.names, j.samples) == (".", 7, ["a", "b"], 2)
    rows = [(0, "gene", "g", [], None), (1, "mRNA", "t", ["g"], None), (2, "exon", "e", ["t"], None), (3, "gene", "g", [], None), (4, "mRNA", "u", [], "h"), (5, "CDS", "c", ["u"], None), (6, "exon", "f", [], None), (7, "exon", "k", ["g"], None)]
    blocks = evidence_tables.gene_blocks(spark.createDataFrame(rows, "row_idx long, feature string, id string, parents array<string>, gene_ref string"))
    assert {r.row_idx: r.block for r in blocks.collect()} == {0: "g", 1: "g", 2: "g", 3: "g__duplicate_2", 4: "h", 5: "h", 7: "g"}
    assert evidence_tables.header_value(lines(["##gff", "# current_gff: /a/b", "x"]), "current_gff") == "/a/b"
    regions = spark.createDataFrame([("Pt", "region", "genome=Chloroplast"), ("1", "region", "genome=chromosome"), ("Pt", "gene", "")], "seqid string, feature string, attributes string")
    assert [r.seqid for r in evidence_tables.organelles(regions).collect()] == ["Pt"]
    manifest = spark.createDataFrame([("a", "yes"), ("b", "no"), ("c", None)], "sample_id string, include string")
    assert sorted(r.sample_id for r in evidence_tables.included(manifest).collect()) == ["a", "c"] and evidence_tables.sample_ids(manifest).count() == 3
    summary = spark.createDataFrame([(0, "", "m", "x"), (1, None, "m", "y"), (2, "n", "q", "z")], "row_idx long, model_id string, object_id string, v string")
    assert {(r.key, r.v) for r in evidence_tables.summary_by_model(summary).collect()} == {("m", "y"), ("n", "z")}


def test_compressed_tables_and_their_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string").coalesce(1)
    for name in ("a", "b"):
        writers.write_table(df, str(tmp_path / name), ["id", "v"], compressed=True)
    a, b = ([(r.bytes, r.sha256) for r in writers.digests(spark, str(tmp_path / n)).collect()] for n in ("a", "b"))
    assert a == b and len(a) == 1 and readers.table(spark, str(tmp_path / "a")).count() == 2


def test_long_read_folders_whose_columns_differ(spark, tmp_path):
    """Columns are met by name in each source; a folder without a table is passed over, and none at all is an error."""
    import pytest

    for own, text_ in (("a", "model_id\tsupport_class\tconflicting_chain_count\nt1\texact\t2\nt1\tpartial\t3\n"), ("b", "conflicting_chain_count\tmodel_id\trisk_tags\n1\tt2\tx;y\n"), ("c", "")):
        (tmp_path / own).mkdir()
        if text_:
            (tmp_path / own / evidence_tables.BY_MODEL).write_text(text_)
    with pytest.raises(FileNotFoundError):
        evidence_tables.long_read_tables(spark, str(tmp_path))
    (tmp_path / "a" / evidence_tables.BY_SET).write_text("locus_id\tsupport_level\ng\texact\n")
    models, genes = evidence_tables.long_read_tables(spark, str(tmp_path))
    assert sorted((r.source, r.transcript, r.support, r.conflicts, r.risks) for r in models.collect()) == [("a", "t1", "partial", 3, []), ("b", "t2", "", 1, ["x", "y"])]
    assert [(r.source, r.gene_id, r.level) for r in genes.collect()] == [("a", "g", "exact")]


FAR = 2_250_000_000


def test_rows_beyond_31_bits(spark):
    lines = [(0, f"chr1\tx\texon\t{FAR}\t{FAR + 9}.0\t.\t+\t.\tID=a"), (1, f"chr1\tx\texon\t{FAR + 9}\t{FAR}\t.\t+\t.\tID=b")]
    got = readers.gff_rows(spark.createDataFrame(lines, "row_idx long, line string")).select("row_idx", "start", "end").collect()
    assert sorted(map(tuple, got)) == [(0, FAR, FAR + 9), (1, FAR, FAR + 9)]


def test_rejects_beyond_31_bits(spark):
    lines = [(0, f"chr1\tx\texon\t{FAR}\t{FAR + 9}\t.\t+\t.\tID=a"), (1, f"chr1\tx\texon\t{FAR + 9}\t{FAR}\t.\t+\t.\tID=b")]
    got = readers.gff_rows(spark.createDataFrame(lines, "row_idx long, line string"), strict=True).select("row_idx", "reject").collect()
    assert sorted(map(tuple, got)) == [(0, None), (1, "order")]


def test_junctions_beyond_31_bits(spark):
    row = ("chr1", str(FAR), f"{FAR + 9}.0", "", "20", "1", "s1")
    names = "chrom intron_start_1based intron_end_1based strand junction_read_count sample_support_count supporting_samples"
    (got,) = evidence_tables.junction_tables(spark.createDataFrame([row], names.replace(" ", " string, ") + " string"), 20, 1).collect()
    assert (got.start, got.end, got.reads) == (FAR, FAR + 9, 20)
    lines = [(0, names.split(" supp")[0].replace(" ", "\t")), (1, "\t".join(row[:6]))]
    (told,) = evidence_tables.junction_file(spark.createDataFrame(lines, "row_idx long, line string"), F.lit("s")).collect()
    (bare,) = evidence_tables.junction_file(spark.createDataFrame([(0, f"chr1\t{FAR}\t{FAR + 9}\t1\t1\t0\t4\t3\t30")], "row_idx long, line string"), F.lit("s")).collect()
    assert {(r.start, r.end) for r in (told, bare)} == {(FAR, FAR + 9)}
