"""Readers and sinks on small files that hold the awkward cases."""

import csv
import gzip
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from splicelake.operators import crosswalk as xw
from splicelake.plans import text_inputs
from splicelake.sinks import tables as sinks
from splicelake.sources import checks, ensembl, flatfile, interpro, quoted_csv, refseq, tables
from splicelake.sources.first_lines import first_lines
from splicelake.sources.gff3 import attr, read_gff3


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def gff(path, lines):
    path.write_text("##gff-version 3\n" + "\n".join("\t".join(x) for x in lines) + "\n")
    return str(path)


def line(seq, kind, s, e, attrs, strand="+"):
    return (seq, "src", kind, str(s), str(e), ".", strand, ".", attrs)


@pytest.fixture(scope="module")
def refseq_parts(spark, tmp_path_factory):
    path = gff(
        tmp_path_factory.mktemp("r") / "refseq.gff",
        [
            line("NC1", "region", 1, 9999, "ID=r1;Name=old"),
            line("NC1", "region", 1, 9999, "ID=r1b;Name=1"),
            line("NCX", "region", 1, 9999, "ID=rx;Name=X"),
            line("NCY", "region", 1, 9999, "ID=ry;Name=Y"),
            line("NCM", "region", 1, 9999, "ID=rm;Name=MT"),
            line("NT1", "region", 1, 9999, "ID=rt;Name=7"),
            line("NT1", "sequence_feature", 1, 5, "ID=s;Note=Anchor sequence. This sequence is derived from alt loci 3"),
            line("NT2", "region", 1, 9999, "ID=ru;Name=Unknown"),
            line("NC1", "gene", 1, 900, "ID=gene-AB;Dbxref=GeneID:11,HGNC:HGNC:5;gene=AB;gene_biotype=protein_coding;gene_synonym=A1,B%2C2", "-"),
            line("NC1", "gene", 1, 900, "ID=gene-AB-2;Dbxref=GeneID:12;gene=AB;gene_biotype=protein_coding"),
            line("NC1", "gene", 1, 900, "ID=gene-LNC;Dbxref=GeneID:13;gene=LNC;gene_biotype=lncRNA"),
            line("NCY", "gene", 1, 900, "ID=gene-PAR;Dbxref=GeneID:14;gene=PARY;gene_biotype=protein_coding"),
            line("NCX", "gene", 1, 900, "ID=gene-PARX;Dbxref=GeneID:14;gene=PARX;gene_biotype=protein_coding"),
            line("NT1", "gene", 1, 900, "ID=gene-ALT;Dbxref=GeneID:15;gene=ALT;gene_biotype=protein_coding"),
            line("NCM", "gene", 5, 90, "ID=gene-MT;Dbxref=GeneID:16;gene=MTG;gene_biotype=protein_coding"),
            line("NC1", "gene", 1000, 1900, "ID=gene-NOTX;Dbxref=GeneID:17;gene=NOTX;gene_biotype=protein_coding"),
            line("NC1", "mRNA", 101, 900, "ID=rna-NM_1.1;Dbxref=GeneID:11,Ensembl:ENST1.2;gene=AB;transcript_id=NM_1.1;tag=MANE Select", "-"),
            line("NC1", "mRNA", 101, 900, "ID=rna-NM_1.1-2;Dbxref=GeneID:11;gene=AB;transcript_id=NM_1.1"),
            line("NCX", "mRNA", 101, 900, "ID=rna-NM_2.1;Dbxref=GeneID:11;gene=AB;transcript_id=NM_2.1"),
            line("NCX", "transcript", 11, 90, "ID=rna-NM_3.1;Dbxref=GeneID:14;gene=PARX;transcript_id=NM_3.1;tag=other,RefSeq Select"),
            line("NC1", "exon", 701, 900, "ID=exon-NM_1.1-1;Parent=rna-NM_1.1", "-"),
            line("NC1", "exon", 101, 300, "ID=exon-NM_1.1-2;Parent=rna-NM_1.1", "-"),
            line("NC1", "exon", 101, 300, "ID=exon-NM_1.1-2-2;Parent=rna-NM_1.1", "-"),
            line("NCX", "exon", 101, 300, "ID=exon-NM_1.1-3;Parent=rna-NM_1.1"),
            line("NC1", "CDS", 701, 800, "ID=cds-1;Parent=rna-NM_1.1;Name=NP_1.1", "-"),
            line("NC1", "CDS", 201, 300, "ID=cds-1;Parent=rna-NM_1.1;Name=NP_1.1", "-"),
            line("NCM", "CDS", 5, 90, "ID=cds-m;Parent=gene-MT;Dbxref=GeneID:16;gene=MTG;Name=YP_1.1"),
        ],
    )
    f = read_gff3(spark, path)
    chrom = refseq.seqid_to_chromosome(f)
    genes = refseq.refseq_genes(f, chrom)
    return f, chrom, genes, refseq.refseq_transcripts(f, chrom, genes)


def test_refseq(refseq_parts):
    f, chrom, genes, tx = refseq_parts
    assert dict(rows(chrom, "seqid", "chromosome")) == {"NC1": "1", "NCX": "X", "NCY": "Y", "NCM": "MT", "NT1": "ALT_chr", "NT2": "Unknown"}
    assert rows(genes, "gene_geneid_id", "gene_symbol", "synonyms", "chromosome") == [
        ("11", "AB", "A1; B,2", "1"), ("14", "PARX", " ", "X"), ("16", "MTG", " ", "MT"), ("17", "NOTX", " ", "1")
    ]
    assert rows(tx, "transcript_refseq_id", "own_ensembl_id", "tx_start", "canonical") == [("NM_1.1", "ENST1.2", 100, 1), ("NM_3.1", None, 10, 1)]
    assert rows(refseq.genes_with_transcripts(genes, tx), "gene_geneid_id") == [("11",), ("14",)]
    assert rows(refseq.refseq_cds(f, chrom, tx), "cds_start", "cds_end", "protein_refseq_id") == [(200, 800, "NP_1.1")]
    assert rows(refseq.refseq_exons(f, chrom, tx), "order_in_transcript", "genomic_start_tx", "genomic_end_tx") == [(1, 700, 900), (2, 100, 300)]
    assert rows(refseq.mito_transcripts(f, chrom), "transcript_refseq_id", "tx_start", "protein_refseq_id") == [("mito-16", 5, "YP_1.1")]


def test_ensembl(spark, tmp_path):
    path = gff(
        tmp_path / "e.gff3",
        [
            line("1", "gene", 1, 900, "ID=gene:G1;Name=A%3BB;gene_id=G1"),
            line("KI270", "gene", 1, 900, "ID=gene:G2;gene_id=G2"),
            line("2", "gene", 1, 900, "ID=gene:G3;gene_id=G3"),
            line("1", "mRNA", 11, 900, "ID=transcript:T1;Parent=gene:G1;biotype=nonsense_mediated_decay;tag=basic,Ensembl_canonical;transcript_id=T1;version=4"),
            line("1", "mRNA", 11, 900, "ID=transcript:T2;Parent=gene:GX;biotype=x;transcript_id=T2;version=1"),
            line("1", "CDS", 301, 400, "ID=CDS:P1;Parent=transcript:T1;protein_id=P1"),
            line("1", "CDS", 101, 200, "ID=CDS:P1;Parent=transcript:T1;protein_id=P1b"),
            line("1", "exon", 301, 450, "Parent=transcript:T1;rank=2"),
            line("1", "exon", 51, 200, "Parent=transcript:T1;rank=1"),
        ],
    )
    f = read_gff3(spark, path)
    genes = ensembl.ensembl_genes(f)
    tx = ensembl.ensembl_transcripts(f, genes)
    assert rows(genes, "gene_ensembl_id", "gene_symbol") == [("G1", "A;B"), ("G3", "G3")]
    assert rows(tx, "transcript_ensembl_id", "nmd", "canonical", "tx_start") == [("T1.4", True, 2, 10)]
    assert rows(ensembl.genes_with_transcripts(genes, tx), "gene_ensembl_id") == [("G1",)]
    assert rows(ensembl.ensembl_cds(f, tx), "cds_start", "cds_end", "protein_ensembl_id") == [(100, 400, "P1")]
    assert rows(ensembl.ensembl_exons(f, tx), "order_in_transcript", "genomic_start_tx") == [(1, 50), (2, 300)]
    assert f.filter(attr("Name").isNotNull()).count() == 1

    cds = spark.createDataFrame([("T1.4", 101), ("T1.4", 50)], "transcript_ensembl_id string, abs_end_cds long")
    domains = spark.createDataFrame([("P1.1", 1), ("P9.1", 2)], "protein_ensembl_id string, type_id int")
    pairs = spark.createDataFrame([("P1.1", "T1.4"), ("P9.1", "T9.1")], "protein_ensembl_id string, transcript_ensembl_id string")
    proteins, kept, counts = ensembl.ensembl_proteins(pairs, tx, cds, domains)
    assert rows(proteins, "protein_ensembl_id", "description", "length") == [("P1.1", "Nonsense Mediated Decay (NMD)", 32)]
    assert rows(kept, "type_id") == [(1,)]
    assert rows(counts, "found", "not_found") == [(1, 1)]
    unversioned = spark.createDataFrame([("P1", "T1.4")], "protein_ensembl_id string, transcript_ensembl_id string")
    with pytest.raises(Exception, match="without version"):
        ensembl.ensembl_proteins(unversioned, tx, cds, domains)[0].collect()


FLAT = '''LOCUS       NP_1                     120 aa            linear   PRI
DEFINITION  first protein
            of two.
ACCESSION   NP_1
VERSION     NP_1.2
FEATURES             Location/Qualifiers
     source          1..120
                     /organism="Homo sapiens"
     Protein         1..120
                     /note="a note
                     in two lines"
     Region          5..60
                     /region_name="Kinase"
                     /note="the kinase; Region: Kinase; pfam00069"
                     /db_xref="CDD:278497"
     Region          <7..70
                     /region_name="PRK12345"
                     /note="whatever; cd00001"
     Region          10..10
                     /region_name="Single"
                     /note="x; pfam00001"
     Region          11..20
                     /region_name="Taken"
                     /note="propagated from UniProtKB; pfam00002"
     Region          12..22
                     /region_name="NoId"
                     /note="plain"
     Region          13..23
                     /region_name="OnlyCdd"
                     /db_xref="CDD:99"
     CDS             1..120
                     /gene="A"
                     /coded_by="join(NM_1.2:1..50,NM_1.2:60..99)"
ORIGIN
        1 mmmm
//
LOCUS       WP_9                     10 aa
DEFINITION  skipped.
VERSION     WP_9.1
FEATURES             Location/Qualifiers
     CDS             1..10
                     /coded_by="NM_9.1:1..30"
ORIGIN
//
'''


def test_flatfile(spark, tmp_path):
    p = tmp_path / "p.gpff"
    p.write_text(FLAT)
    records = flatfile.read_protein_flatfile(spark, str(p))
    proteins = flatfile.proteins(records)
    assert rows(proteins, "protein_refseq_id", "description", "length", "synonyms", "transcript_refseq_id") == [
        ("NP_1.2", "first protein of two", 120, "a note in two lines", "NM_1.2")
    ]
    assert rows(flatfile.regions(records), "name", "aa_start", "aa_end", "ext_id", "cdd", "note") == [
        ("Kinase", 5, 60, "pfam00069", "278497", "the kinase; Region: Kinase"),
        ("OnlyCdd", 13, 23, None, "99", None),
        ("PRK12345", 7, 70, "PRK12345", None, "whatever; cd00001"),
    ]
    assert rows(flatfile.trans2pro(proteins), "id", "other") == [("NM_1.2", "NP_1.2")]


def test_domain_table_headers(spark, tmp_path):
    joined = tmp_path / "a.txt"
    joined.write_text("Transcript stable ID version\tProtein stable ID version\tPfam ID\tPfam start\tPfam end\nT1.1\tP1.1\tPF00001\t1\t9\nT2.1\tP2.1\t\t\t\n")
    split = tmp_path / "b.txt"
    split.write_text("Transcript stable ID\tVersion (transcript)\tProtein stable ID\tVersion (protein)\tSMART ID\tSMART start\tSMART end\nT1\t1\tP1\t3\tSM00001\t2\t8\nT3\t\tP3\t1\tSM00002\t2\t8\n")
    a = tables.normalized_domains(tables.read_domain_table(spark, str(joined), "pfam"), "pfam")
    b = tables.normalized_domains(tables.read_domain_table(spark, str(split), "smart"), "smart")
    assert rows(a, "transcript_ensembl_id", "ext_id", "aa_start") == [("T1.1", "pfam00001", 1)]
    assert rows(b, "protein_ensembl_id", "ext_id") == [("P1.3", "smart00001")]
    page = tmp_path / "c.txt"
    page.write_text("<html>\nsorry\n")
    with pytest.raises(ValueError):
        tables.read_domain_table(spark, str(page), "pfam")


def test_header_check(spark, tmp_path):
    (tmp_path / "good.txt").write_text("  Gene stable ID\tx\nrow\n")
    (tmp_path / "bad.txt").write_text("<html>\nGene stable ID\n")
    got = {r.file.split("/")[-1]: (r.is_valid, r.is_error_page) for r in checks.sniff_headers(spark, str(tmp_path), ["Gene stable ID"]).collect()}
    assert got == {"good.txt": (True, False), "bad.txt": (False, True)}


def test_crosswalk(spark, tmp_path):
    p = tmp_path / "g2e.txt"
    p.write_text(
        "#tax\tg\teg\trt\tet\trp\tep\n"
        "9606\t1\tENSG1\tNM_1.1\tENST1.1\tNP_1.1\tENSP1.1\n9606\t1\tENSG9\tNM_2.1\tENST2.1\tNP_2.1\t-\n"
        "9606\t3\tENSG3\t-\t-\tYP_3.1\tENSP3.1\n10090\t4\tENSG4\tNM_4.1\tENST4.1\tNP_4.1\tENSP4.1\n9606\t1\tENSG1\tNM_1.1\tENST7.1\tNP_1.1\t-\n"
    )
    clean = xw.clean_crosswalk(tables.read_id_crosswalk(spark, str(p)), 9606)
    genes = dict(rows(xw.gene_map(clean), "id", "other"))
    assert genes["1"] == "ENSG1" and genes["ENSG9"] == "1" and "4" not in genes
    tx = dict(rows(xw.transcript_map(clean), "id", "other"))
    assert tx["NM_1.1"] == "ENST7.1" and tx["ENST1.1"] == "NM_1.1" and tx["mito-3"] == "mito-ENSG3"
    assert dict(rows(xw.protein_map(clean), "id", "other"))["NP_1.1"] is None
    facts = xw.crosswalk_facts(clean)
    asked = spark.createDataFrame([("NM_1.1",), ("ENST2.1",), ("ENSP1.1",), ("nothing",)], "id string")
    assert rows(xw.transcript_protein_lookup(asked, "id", facts, "answer"), "id", "answer") == [
        ("ENSP1.1", "ENST7.1"), ("ENST2.1", None), ("NM_1.1", "NP_1.1"), ("nothing", None)
    ]
    mt = spark.createDataFrame(
        [(None, "ENST-MT.1", None, "ENSG3", None, None, "MT")],
        "transcript_refseq_id string, transcript_ensembl_id string, gene_geneid_id string, gene_ensembl_id string, "
        "protein_refseq_id string, protein_ensembl_id string, chromosome string",
    )
    assert rows(xw.fill_missing_ids(mt, facts), "transcript_refseq_id", "gene_geneid_id") == [("mito-3", "3")]


MATCHES = """<?xml version="1.0"?>
<interpromatch>
<protein id="P1" name="a"><match id="PF1" name="pfam one"><ipr id="IPR1" name="entry one"/><lcn start="1" end="9" representative="true" score="2.5"/>
<lcn start="20" end="30"/></match><match id="G3D" name=""><lcn start="3" end="8" representative="true"/></match></protein>
<protein id="P2" name="b"><match id="PF1" name="x"><lcn start="1" end="9" representative="true"/></match></protein>
</interpromatch>
"""
ENTRIES = """<interprodb>
<interpro id="IPR1" type="Domain"><name>n</name><abstract><p>Binds  <cite idref="P"/> DNA &amp; RNA.</p>
<p>More.</p></abstract></interpro>
<interpro id="IPR2" type="Repeat"><name>n</name></interpro>
</interprodb>
"""


def test_interpro_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text(MATCHES)
    with gzip.open(tmp_path / "e.xml.gz", "wt") as f:
        f.write(ENTRIES)
    matches = interpro.read_interpro_matches(spark, str(tmp_path / "m.xml"))
    entries = interpro.read_interpro_descriptions(spark, str(tmp_path / "e.xml.gz"))
    assert rows(entries, "accession", "type", "description") == [("IPR1", "Domain", "Binds DNA & RNA. More."), ("IPR2", "Repeat", None)]
    stored = spark.createDataFrame([("P1",), (None,)], "protein_interpro_id string")
    got = interpro.representative_domains(matches, stored, entries)
    assert rows(got, "domain_id", "domain_name", "start", "end", "score", "type") == [
        ("G3D", "", 3, 8, None, None), ("IPR1", "entry one", 1, 9, 2.5, "Domain")
    ]


def test_entry_list_uniprot_and_genepred(spark, tmp_path):
    (tmp_path / "i.txt").write_text("IPR1|Kinase|interpro|domain|pfam:PF00069,PF1;smart:SM0022;prints:PR1||\n")
    idx = interpro.entry_index(interpro.read_entry_list(spark, str(tmp_path / "i.txt")))
    assert rows(idx, "source", "ext_id") == [("interpro", "IPR1"), ("pfam", "pfam00069"), ("pfam", "pfam1"), ("smart", "smart0022")]
    with gzip.open(tmp_path / "u.tab.gz", "wt") as f:
        f.write("\t".join(["A1", "", "", "NP_1.1"] + [""] * 15 + ["ENST1"] + ["", ""]) + "\n")
        f.write("\t".join(["A2"] + [""] * 21) + "\n")
    assert rows(interpro.read_uniprot_idmap(spark, str(tmp_path / "u.tab.gz")), "accession", "refseq_id", "enst_id") == [
        ("A1", "NP_1.1", "ENST1"), ("A2", "", "")
    ]
    (tmp_path / "g.txt").write_text("uc1\tchr1\t+\t10\t90\t20\t80\t2\t10,50,\t30,90,\nuc1\tchr2\t+\t1\t2\t1\t2\t1\t1,\t2,\n")
    got = tables.genepred_exons(tables.read_genepred(spark, str(tmp_path / "g.txt")))
    assert rows(got, "chromosome", "order_in_transcript", "genomic_start_tx", "genomic_end_tx") == [("chr1", 1, 10, 30), ("chr1", 2, 50, 90)]


def test_locations_text(spark):
    df = spark.sql("SELECT from_json('[{\"fragments\":[{\"start\":1,\"end\":5},{\"start\":8,\"end\":9}]},{\"fragments\":[{\"start\":20,\"end\":30}]}]', "
                   "'array<struct<fragments:array<struct<start:int,end:int>>>>') AS l")
    assert df.select(interpro.locations_text(F.col("l"))).first()[0] == "1..5,8..9,20..30"


def test_result_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('cluster,text\nc1,"a, ""b""\nnext"\nc1,x\nc2,y\n')
    df = checks.read_result_csv(spark, str(p))
    assert rows(df, "cluster", "text") == [("c1", 'a, "b"\nnext'), ("c1", "x"), ("c2", "y")]
    assert rows(checks.cluster_counts(df), "n_rows", "n_clusters") == [(3, 2)]
    assert checks.preview(df, 2).count() == 2


def test_quoted_csv_in_splits_equals_whole_files(spark, tmp_path):
    rnd = random.Random(4)
    signs = ["a", ",", '"', "\n", "\r\n", " ", "é", "", "long field " * 4]
    for part in ("p=1", "p=2"):
        (tmp_path / part).mkdir()
        with (tmp_path / part / "r.csv").open("w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if part == "p=1" else "\r\n", quoting=csv.QUOTE_ALL)
            out.writerow(["key", "two\nlines", "n"])
            for k in range(400):
                out.writerow([f"k{k}", "".join(rnd.choice(signs) for _ in range(rnd.randrange(9))), k])
            f.write('\n"last",x,' + "7")
    (tmp_path / "p=1" / "empty.csv").write_text("")
    schema = "key string, said string, n int"
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700b")
    try:
        for given in (schema, None):
            split, whole = (checks.read_result_csv(spark, str(tmp_path), given, stray_quotes=stray) for stray in (False, True))
            assert split.columns == whole.columns
            assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
            assert split.count() == 802
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_lines_read_one_block(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("head\r\n" + "row\n" * 100_000)
    (tmp_path / "long.txt").write_text("é" * 5000 + "\nx")
    (tmp_path / "blank.txt").write_text("\nx\n")
    (tmp_path / "one.txt").write_text("no end")
    (tmp_path / "empty.txt").write_text("")
    with gzip.open(tmp_path / "z.gz", "wt") as f:
        f.write("packed\nrow\n")
    got = {r["file"].split("/")[-1]: r for r in first_lines(spark, str(tmp_path), block=1024).collect()}
    assert {k: r["first_line"] for k, r in got.items()} == {
        "a%20b.txt": "head", "long.txt": "é" * 5000, "blank.txt": "", "one.txt": "no end", "z.gz": "packed",
    }
    assert got["a%20b.txt"]["bytes_read"] == 1024 and got["long.txt"]["bytes_read"] <= 10_240 + 1024


def test_sinks(spark, tmp_path):
    genes = spark.createDataFrame(
        [("1", "E1", "A", None, "1", "+", "H_sapiens"), ("2", "E2", "B", "x", "2", "-", "M_musculus")],
        "gene_geneid_id string, gene_ensembl_id string, gene_symbol string, synonyms string, chromosome string, strand string, specie string",
    )
    sinks.write_table(sinks.conform(genes, "genes"), str(tmp_path), "genes")
    assert checks.load_table(spark, str(tmp_path), "genes", "M_musculus").count() == 1
    assert sorted(p.name for p in (tmp_path / "genes").glob("specie=*")) == ["specie=H_sapiens", "specie=M_musculus"]
    export = genes.select("gene_symbol", F.col("specie").alias("species"))
    sinks.export_transcript_domains_csv(export, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "all_species")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "by_species")).filter("species = 'H_sapiens'").count() == 1


def test_an_export_computes_its_rows_once(spark, tmp_path):
    rows = spark.range(40).selectExpr("uuid() AS gene_symbol", "IF(id % 2 = 0, 'H_sapiens', 'M_musculus') AS species")
    sinks.export_transcript_domains_csv(rows, str(tmp_path))
    read = lambda part: {r.gene_symbol for r in spark.read.option("header", True).csv(f"{tmp_path}/{part}").collect()}
    assert read("all_species") == read("by_species") == read("preview")


def test_quoted_csv_gathers_only_files_with_records_over_several_lines(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"plain{k}.csv").write_text("id,text\r\n" + "".join(f'{k}{i},"a, ""b"" {i}"\r\n' for i in range(50)))
    with monkeypatch.context() as m:
        m.setattr(quoted_csv, "_gathered", None)
        got = quoted_csv.read_quoted_csv(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"{k}{i}", f'a, "b" {i}') for k in range(3) for i in range(50))
    (tmp_path / "broken.csv").write_text('id,text\n' + "".join(f'9{i},"x\n""y"", {i}\n"\n' for i in range(30)))
    both = quoted_csv.read_quoted_csv(spark, str(tmp_path)).filter("id LIKE '9%'").collect()
    assert sorted(map(tuple, both)) == sorted((f"9{i}", f'x\n"y", {i}\n') for i in range(30))
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path)).count() == 180


def test_xml_elements_without_content_hide_no_neighbour(spark, tmp_path):
    lcn = '<lcn start="1" end="9" score="2.5" representative="true"/>'
    full = lambda k: f'<protein id="{k}"><match id="M{k}" name="a/b"><ipr id="I{k}" name="n"/>{lcn}</match></protein>\n'
    (tmp_path / "m.xml").write_text(f'<interpromatch>\n{full("A")}<protein id="B" name="x > y / z"/>\n<protein id="D" />{full("C")}</interpromatch>\n')
    got = interpro.read_interpro_matches(spark, str(tmp_path / "m.xml")).select("protein_interpro_id", "domain_id", "start", "end").collect()
    assert sorted(map(tuple, got)) == [("A", "IA", 1, 9), ("C", "IC", 1, 9)]
    (tmp_path / "d.xml").write_text('<db><interpro id="I1" type="Family"/><interpro id="I2" type="Domain"><abstract>a <b>b</b></abstract></interpro></db>')
    got = interpro.read_interpro_descriptions(spark, str(tmp_path / "d.xml")).collect()
    assert sorted(map(tuple, got), key=str) == [("I1", "Family", None), ("I2", "Domain", "a b")]


def test_load_table_filters_every_table_of_a_species(spark, tmp_path):
    df = spark.sql("SELECT 'NM_1' AS transcript_refseq_id, 'H_sapiens' AS specie UNION ALL SELECT 'NM_2', 'M_musculus'")
    sinks.write_table(sinks.conform(df, "transcripts"), str(tmp_path), "transcripts", by_species=False)
    got = checks.load_table(spark, str(tmp_path), "transcripts", "M_musculus").collect()
    assert [r.transcript_refseq_id for r in got] == ["NM_2"]


def test_first_lines_of_many_files_are_found_by_tasks(spark, tmp_path):
    (tmp_path / "k=1" / "deep").mkdir(parents=True)
    (tmp_path / "k=2").mkdir()
    (tmp_path / "_temporary").mkdir()
    names = ["k=1/a b.txt", "k=1/ü#%41[1].txt", "k=2/.hidden", "k=2/_log", "k=2/c;d+e.txt", "_temporary/no.txt"]
    for n in names:
        (tmp_path / n).write_text(f"{n}\nx\n")
    got = first_lines(spark, str(tmp_path))
    assert got.inputFiles() == []  # no name passes the driver
    scanned = spark.read.format("binaryFile").load(str(tmp_path)).select("_metadata.file_path").collect()
    assert sorted(r.file for r in got.collect()) == sorted(r.file_path for r in scanned)
    assert sorted(r.first_line for r in got.collect()) == sorted([names[0], names[1], names[4]])
    assert [r.first_line for r in first_lines(spark, str(tmp_path / "k=2" / "c*")).collect()] == [names[4]]
    with pytest.raises(AnalysisException):
        first_lines(spark, str(tmp_path / "none"))


def test_rows_of_one_value_become_one_file(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b\\nc'), (2L, 'd'), (-3L, NULL), (NULL, 'e') AS t(k, value)")
    for _ in range(2):  # earlier files go
        text_inputs._files_of_their_own(df, "k", str(tmp_path / "out"))
    found = {p.parent.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "out").glob("part=*/*/*.txt")}
    assert found == {"k=1": ["a"], "k=2": ["b", "c", "d"], "k=-3": [""], "k=__HIVE_DEFAULT_PARTITION__": ["e"]}
    assert len(list((tmp_path / "out").glob("part=*/*/*.txt"))) == 4
