"""The store of all species: keys, versions, carried types, added columns."""

import pytest
from pyspark.sql import functions as F

from splicelake.plans import text_inputs as files
from splicelake.plans.build import SpeciesInputs, build_merged
from splicelake.plans.derived import Tables
from splicelake.sinks import store as st
from splicelake.sinks.store import Store


def species_of(spark, specie, n, types, exons=2):
    """A small species with the builder's own text keys; ``types`` is (ext_id, type_id, name) of its domains."""
    genes = spark.createDataFrame([(f"g{i}", f"{specie}{i}", None if i % 2 else f"E{specie}{i}", f"SYM{i}", specie) for i in range(n)],
                                  "gene_key string, gene_geneid_id string, gene_ensembl_id string, gene_symbol string, specie string")
    tx = spark.createDataFrame([(f"t{i}", f"g{i}", f"NM_{specie}{i}", None if i % 3 else f"ENST{specie}{i}", 100, 900) for i in range(n)],
                               "tx_key string, gene_key string, transcript_refseq_id string, transcript_ensembl_id string, tx_start long, tx_end long")
    cds = spark.createDataFrame([(f"t{i}", f"g{i}", k + 1, 100 + 200 * k, 200 + 200 * k, 100 * k + 1, 100 * k + 100, k + 1) for i in range(n) for k in range(exons)],
                                "tx_key string, gene_key string, order_in_transcript int, genomic_start_tx long, genomic_end_tx long, abs_start_cds long, abs_end_cds long, coding_rank long")
    events = spark.createDataFrame([(f"t{i}", t, 1, 20, x) for i in range(n) for x, t, _ in types], "tx_key string, type_id long, aa_start long, aa_end long, ext_id string")
    facts = spark.createDataFrame([(x, None, None, name, None, t) for x, t, name in types], st.FACTS)
    proteins = tx.select("tx_key", "gene_key", F.concat(F.lit("NP_"), "transcript_refseq_id").alias("protein_refseq_id"), F.lit(40).alias("length"))
    return {"genes": genes, "transcripts": tx, "transcript_exon": cds, "proteins": proteins, "domain_event": events}, facts


def keys_of(store, name, by, key):
    return {r[by]: r[key] for r in store.load(name).select(by, key).collect()}


def test_species_share_one_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.type_ids() is None and store.load("genes").count() == 0
    store.add("A", *species_of(spark, "A", 4, [("pfam1", 1, "long name"), ("smart2", 2, None)]))
    first = keys_of(store, "transcripts", "transcript_refseq_id", "tx_key")
    store.add("B", *species_of(spark, "B", 3, [("pfam1", 1, "short"), ("cd3", 3, "third")]))
    assert store.versions() == [1, 2] and store.species() == ["A", "B"]
    both = keys_of(store, "transcripts", "transcript_refseq_id", "tx_key")
    assert len(set(both.values())) == 7 and first.items() <= both.items()
    # Keys mean the same row in every table.
    exons = store.load("transcript_exon").join(store.load("transcripts").select("tx_key", F.col("gene_key").alias("gk")), "tx_key")
    assert exons.count() == 14 and exons.filter("gk <> gene_key").count() == 0
    assert store.load("genes").select("gene_key").distinct().count() == 7
    assert store.load("proteins", "B").count() == 3 and store.load("domain_event", "A").count() == 8
    # Types of A stay although B has no smart2; the shortest name of all species leads.
    types = {r["type_id"]: (r["name"], r["other_name"]) for r in store.load("domain_type").collect()}
    assert types == {1: ("short", "long name"), 2: (None, None), 3: ("third", None)}
    assert {tuple(r) for r in store.type_ids().collect()} == {("pfam1", 1), ("smart2", 2), ("cd3", 3)}
    tables = store.operator_tables("A")
    assert {len(df.filter("tx_key IS NULL").take(1)) for n, df in tables.items() if n != "genes"} == {0}


def test_built_again_a_species_keeps_its_keys_and_old_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add("A", *species_of(spark, "A", 3, [("pfam1", 1, "n")]))
    before = keys_of(store, "genes", "gene_geneid_id", "gene_key")
    store.add("A", *species_of(spark, "A", 5, [("pfam1", 1, "n")]))
    after = keys_of(store, "genes", "gene_geneid_id", "gene_key")
    assert len(after) == len(set(after.values())) == 5 and before.items() <= after.items()
    assert store.load("genes", version=1).count() == 3 and store.load("keys").count() == 10


def test_a_build_that_fails_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    tables, facts = species_of(spark, "A", 3, [("pfam1", 1, "n")])
    store.add("A", tables, facts)
    broken = {**tables, "proteins": tables["proteins"].withColumn("length", F.raise_error(F.lit("lost")).cast("long"))}
    with pytest.raises(Exception, match="lost"):
        store.add("B", broken, facts)
    assert store.versions() == [1] and store.species() == ["A"]


def test_added_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add("A", *species_of(spark, "A", 3, [("pfam1", 1, "n")]))
    assert "note" not in store.load("proteins").columns
    store.add_column("proteins", "note", "STRING")
    assert store.load("proteins").filter("note IS NULL").count() == 3
    values = spark.createDataFrame([("NP_NM_A1", "seen")], "protein_refseq_id string, note string")
    store.add_column("proteins", "note", "STRING", values)
    store.add("B", *species_of(spark, "B", 2, [("pfam1", 1, "n")]))  # written without the column
    got = {r["protein_refseq_id"]: r["note"] for r in store.load("proteins").collect()}
    assert got == {"NP_NM_A0": None, "NP_NM_A1": "seen", "NP_NM_A2": None, "NP_NM_B0": None, "NP_NM_B1": None}
    assert "note" not in store.load("proteins", version=1).columns
    with pytest.raises(ValueError):
        store.add_column("orthology", "x", "INT")


def test_build_merged_from_files(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    entries = str(tmp_path / "entries.txt")
    t.entries.select(
        "accession", F.lit("n").alias("name"), F.lit("interpro").alias("db"), "entry_type", "members", F.lit("").alias("go"), F.lit("").alias("r")
    ).filter("members <> ''").write.option("sep", "|").csv(entries)
    paths = SpeciesInputs("H_sapiens", files.refseq_gff(t), files.protein_flatfile(t), files.ensembl_gff(t), files.domain_tables(t), files.crosswalk_file(t))
    out = str(tmp_path / "db")
    store = build_merged(spark, [paths], entries, out, apart=("H_sapiens",), orthology_pairs=files.orthology_files(t))
    alone = Store(spark, f"{out}/H_sapiens")
    for name in ("genes", "transcripts", "transcript_exon", "proteins", "domain_event", "domain_type", "splice_in_domains"):
        assert store.load(name).count() == alone.load(name).count() > 0, name
    assert "orthology" in {r["table"] for r in store.contents()} and store.load("orthology").count() == 0  # one species has no pairs
    tx = store.load("transcripts")
    assert tx.filter("tx_key IS NULL OR gene_key IS NULL").count() == 0
    assert tx.join(store.load("genes"), "gene_key", "left_anti").count() == 0
    assert store.load("domain_event").join(store.load("domain_type"), "type_id", "left_anti").count() == 0
    assert store.load("transcript_exon").join(tx, "tx_key", "left_anti").count() == 0


def test_each_table_is_dealt_to_its_species_once(spark, tmp_path, monkeypatch):
    """However many species there are, the exons and proteins of all are read and joined once."""
    from collections import Counter

    from splicelake.plans import derived, queries_store

    asked = Counter()
    keep = derived.Tables.__getattr__
    t = derived.Tables(spark, "/root/testdata/sf0.001")
    t.prepare()
    monkeypatch.setattr(derived.Tables, "__getattr__", lambda self, name: asked.update([name]) or keep(self, name))
    store = queries_store.build_store(t, str(tmp_path / "store"))
    assert asked["cds"] == 2 and asked["proteins"] == 2 and asked["transcripts"] == 1
    assert store.load("transcript_exon").count() == t.cds.count() and store.load("proteins").count() == t.proteins.count()


def test_staged_by_a_column_reads_one_value_alone(spark):
    from splicelake.session import staged

    df = staged(spark.range(40).selectExpr("id", "concat('s', id % 4) AS specie"), by="specie")
    assert sorted(r.id for r in df.filter("specie = 's1'").collect()) == list(range(1, 40, 4))
    assert all("specie=" in f for f in df.inputFiles())
