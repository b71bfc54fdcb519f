"""What is shuffled or written once, and that the rows stay the same."""

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from splicelake.llm.common import stage
from splicelake.operators import search as se
from splicelake.operators import similarity as sim
from splicelake.plans import queries_domains, text_inputs
from splicelake.session import staged
from splicelake.sources.gff3 import read_gff3


def _scores(df):
    return {(r["pair_key"], r["a_tx"], r["b_tx"]): round(r["similarity"], 9) for r in df.collect()}


def test_pairs_of_lists_score_as_pairs_of_exons(spark):
    exon = "gene_key long, tx_key long, order_in_transcript int, s long, e long, coding_len long, n_complete long"
    rows = [
        (1, 1, 1, 0, 90, 30, 1), (1, 1, 2, 200, 300, 60, 0), (1, 1, 3, 500, 500, 0, 0),
        (1, 2, 1, 0, 90, 30, 2), (1, 2, 2, 250, 340, 90, 1), (1, 2, 3, 900, 960, 60, 1),
        (1, 3, 1, 5000, 5100, None, 1), (1, 3, 2, None, 40, 30, 0), (1, 3, 3, 210, 320, None, 0),
        (2, 4, 1, 0, 90, 30, 0), (2, 4, 1, 100, 190, 60, 0), (2, 5, 1, 0, 91, 60, 0), (2, 6, None, 0, 91, 30, 0),
    ]
    types = [(1, 1, 7, 1), (2, 1, 7, 1), (2, 1, 8, 1), (2, 2, 7, 1), (2, 3, 9, 1), (3, 1, 9, 1)]
    pairs = [(10, 1, 2), (11, 2, 3), (12, 1, 3), (13, 3, 9), (14, 8, 9), (15, 4, 5), (16, 5, 6), (17, 1, 5), (17, 2, 5), (None, 1, 2)]
    x, t = spark.createDataFrame(rows, exon), spark.createDataFrame(types, "tx_key long, order_in_transcript int, type_id long, n_type long")
    p = spark.createDataFrame(pairs, "pair_key long, a_tx long, b_tx long")
    lists = _scores(sim.transcript_similarity(p, x, t, (1.0, 2.0, 0.5)))
    by_exon = _scores(sim.transcript_similarity(p, x, t, (1.0, 2.0, 0.5), paired_exons=0))
    assert lists == by_exon == _scores(sim._met_by_exon(p, x, t, (1.0, 2.0, 0.5)))
    assert set(lists) == {(10, 1, 2), (11, 2, 3), (12, 1, 3), (13, 3, 9), (15, 4, 5), (16, 5, 6), (17, 1, 5), (17, 2, 5)}


def test_accessions_are_judged_once(spark, monkeypatch):
    domains = spark.createDataFrame([(k, "pfam01", "CDD1", "a_1") for k in range(50)] + [(9, None, None, None)], "tx_key long, ext_id string, cdd string, name string")
    entries = spark.createDataFrame([("IPR1", "repeat", "pfam:PF01")], "accession string, entry_type string, members string")
    judged = []
    whole = queries_domains.ty.eligible_domains
    monkeypatch.setattr(queries_domains.ty, "eligible_domains", lambda d, index: judged.append(d.count()) or whole(d, index))
    linked = queries_domains._linked(SimpleNamespace(spark=spark, domains=domains, entries=entries))
    assert judged == [2]
    assert [tuple(r) for r in linked.select("ext_id", "accession", "cdd", "name", "note", "entry_type").collect()] == [
        ("pfam01", "IPR1", "CDD1", "a_1", "Repeat_domain", "repeat")
    ]


def test_annotation_is_written_compressed_and_read_in_order(spark, tmp_path):
    lines = [f"1\tsrc\texon\t{k}\t{k + 5}\t.\t+\t.\tParent=transcript:T{k}" for k in range(300)]
    df = spark.createDataFrame([("##gff-version 3",), *[(x,) for x in lines]], "value string").coalesce(1)
    text_inputs._write_lines([df], str(tmp_path / "gff"))
    files = list((tmp_path / "gff").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    assert [r["start"] for r in read_gff3(spark, str(tmp_path / "gff")).orderBy("ord").collect()] == list(range(300))


def test_hits_of_transcripts_are_found_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(se, "staged", lambda df: written.append(df.columns) or staged(df))
    genes = spark.createDataFrame([(1, "H", "ABC", "11", "ENSG1"), (2, "M", "XYZ", None, "ENSG2")], "gene_key long, specie string, gene_symbol string, gene_geneid_id string, gene_ensembl_id string")
    tx = spark.createDataFrame(
        [("NM_1.1", "ENST1.1", "11", "ENSG1"), ("NM_12.1", None, None, "ENSG2")],
        "transcript_refseq_id string, transcript_ensembl_id string, gene_geneid_id string, gene_ensembl_id string",
    ).withColumns({"protein_refseq_id": F.lit(None).cast("string"), "protein_ensembl_id": F.lit(None).cast("string")})
    terms = spark.createDataFrame([("abc",), ("nm_1",), ("ENST1.1",)], "term string")
    found = {(r["term"], r["tier"], r["gene_key"]) for r in se.find_genes(terms, genes, tx).collect()}
    assert found == {("abc", 1, 1), ("nm_1", 3, 1), ("nm_1", 3, 2), ("ENST1.1", 2, 1)}
    assert ["term", "tier", "_t_geneid", "_t_ensembl"] in written


def test_written_tables_are_compressed_well(spark):
    _, path = stage(spark.range(10))
    assert list(Path(path).glob("*.zstd.parquet"))
    assert all(".zstd." in f for f in staged(spark.range(10)).inputFiles())


def test_documents_are_dealt_by_transcript_only(spark):
    """Gene and transcript meet before a transcript has its lists; genes and transcripts without a match stay as they were."""
    ids = "transcript_refseq_id string, transcript_ensembl_id string, protein_refseq_id string, protein_ensembl_id string"
    genes = spark.createDataFrame([(1, "A"), (2, "B"), (None, "C"), (1, "D")], "gene_key long, gene_symbol string")
    genes = genes.withColumns({c: F.lit(None).cast("string") for c in ("gene_geneid_id", "gene_ensembl_id", "synonyms", "chromosome", "strand", "specie")})
    tx = spark.createDataFrame([(1, 10, "a"), (1, None, "b"), (None, 12, "c"), (3, 13, "d")], "gene_key long, tx_key long, transcript_refseq_id string")
    tx = tx.selectExpr("*", *[f"CAST(NULL AS STRING) AS {c.split()[0]}" for c in ids.split(", ")[1:]], "1L AS tx_start", "9L AS tx_end", "0 AS canonical")
    cds = spark.createDataFrame([(10, k, 5, 9, 1, 5) for k in (2, 1)], "tx_key long, order_in_transcript int, genomic_start_tx long, genomic_end_tx long, abs_start_cds long, abs_end_cds long")
    proteins = spark.createDataFrame([(10, "NP", None, None, 7)], "tx_key long, protein_refseq_id string, protein_ensembl_id string, description string, length long")
    domains = spark.createDataFrame([(10, 1, 4, 5, "x", "n")], "tx_key long, aa_start long, aa_end long, type_id long, ext_id string, name string")
    docs = se.gene_document(genes, tx, cds, proteins, domains)
    joins = [line for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert "tx_key" in joins[0]  # the outermost join, with the lists, is not by gene
    got = sorted(((r.gene_symbol, r.tx_key, r.transcript_refseq_id, r.exons and [e.order_in_transcript for e in r.exons], r.domains and len(r.domains), r.protein and r.protein.length, r.exons is None)
                  for r in docs.collect()), key=str)
    assert got == [("A", 10, "a", [1, 2], 1, 7, False), ("A", None, "b", [], [], None, False), ("B", None, None, None, None, None, True),
                   ("C", None, None, None, None, None, True), ("D", 10, "a", [1, 2], 1, 7, False), ("D", None, "b", [], [], None, False)]
