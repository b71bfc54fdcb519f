"""The whole build on files written from the smallest data set."""

from pyspark.sql import functions as F

from splicelake.plans import text_inputs as files
from splicelake.plans.build import SpeciesInputs, build_species
from splicelake.plans.derived import Tables
from splicelake.schemas import STORED_TABLES, stored_schema


def test_build_species(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    entries = str(tmp_path / "entries.txt")
    t.entries.select(
        "accession", F.lit("n").alias("name"), F.lit("interpro").alias("db"), "entry_type", "members", F.lit("").alias("go"), F.lit("").alias("r")
    ).filter("members <> ''").write.option("sep", "|").csv(entries)
    paths = SpeciesInputs(
        "H_sapiens", files.refseq_gff(t), files.protein_flatfile(t), files.ensembl_gff(t), files.domain_tables(t), files.crosswalk_file(t)
    )
    build_species(spark, paths, entries, str(tmp_path / "db"))
    stored = {n: spark.read.parquet(str(tmp_path / "db" / "H_sapiens" / n)) for n in STORED_TABLES if (tmp_path / "db" / "H_sapiens" / n).exists()}
    assert set(stored) == set(STORED_TABLES) - {"orthology", "representative_domains"}
    for name, df in stored.items():
        assert df.count() > 0, name
        assert [c for c in df.columns if c != "specie"] == [f.name for f in stored_schema(name).fields if f.name != "specie"]
    tx = stored["transcripts"]
    for c in ("transcript_refseq_id", "transcript_ensembl_id"):
        assert tx.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").count() == 0
    # Every RefSeq transcript with a protein and every Ensembl transcript is there once.
    refseq = t.proteins.join(t.transcripts.select("tx_key", "gene_geneid_id"), "tx_key").filter(
        "transcript_refseq_id IS NOT NULL AND protein_refseq_id IS NOT NULL AND gene_geneid_id IS NOT NULL"
    )
    assert refseq.join(tx, "transcript_refseq_id", "left_anti").count() == 0
    ens = t.transcripts.filter("transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL")
    assert ens.join(tx, "transcript_ensembl_id", "left_anti").count() == 0
    events, types = stored["domain_event"], stored["domain_type"]
    assert events.join(types, "type_id", "left_anti").count() == 0
    keys = ["transcript_refseq_id", "transcript_ensembl_id", "type_id", "domain_nuc_start", "total_length"]
    pieces = stored["splice_in_domains"].groupBy(*keys).agg(F.sum(F.abs("included_len")).alias("n"), F.count("*").alias("k"))
    assert pieces.filter("n > total_length").count() == 0


def test_orthology_and_representative_domains(spark, tmp_path):
    from splicelake.plans.build import build_orthology, build_representative_domains

    t = Tables(spark, "/root/testdata/sf0.001")
    table = build_orthology(spark, files.orthology_files(t), t.genes, str(tmp_path))
    assert table.count() == t.ortholog_rows.count()
    cells = [F.lit("").alias(f"c{i}") for i in range(22)]
    cells[0], cells[3], cells[19] = F.col("accession"), F.col("refseq_id"), F.col("enst_id")
    t.mapping.select(*cells).coalesce(1).write.option("sep", "\t").option("emptyValue", "").csv(str(tmp_path / "map"))
    (tmp_path / "e.xml").write_text('<db><interpro id="IPR000000048" type="Domain"><abstract>text</abstract></interpro></db>')
    named, found = build_representative_domains(
        spark, str(tmp_path / "map"), files.match_xml(t), str(tmp_path / "e.xml"), t.proteins, str(tmp_path)
    )
    assert named.filter("protein_interpro_id IS NULL").count() == 0
    assert found.join(named, "protein_interpro_id", "left_anti").count() == 0
    assert spark.read.parquet(str(tmp_path / "representative_domains")).count() == found.count() > 0
