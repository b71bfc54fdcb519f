"""What stays on disk: shuffle files of finished writes, tables that nothing reads any more."""

import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from splicelake import session as ses
from splicelake.operators import reconcile as rc
from splicelake.operators import search as se
from splicelake.operators import types as ty
from splicelake.operators.lists import item_rows
from splicelake.operators.ordered import hot_sizes, running_by_key
from splicelake.plans import queries_domains, queries_store
from splicelake.sinks.store import Store


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def staged_folders(spark):
    return set(Path(ses.shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId, "staged").glob("*"))


def path_of(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_staged_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = ses.staged(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and df.count() == 700


def test_the_setting_comes_back_when_the_last_thread_leaves(spark):
    spark.conf.set(ses._CLEAN_UP, "false")
    with ThreadPoolExecutor(4) as pool:
        frames = list(pool.map(lambda k: ses.staged(spark.range(50).repartition(3).withColumn("k", F.lit(k))), range(8)))
    assert spark.conf.get(ses._CLEAN_UP) == "false" and [f.count() for f in frames] == [50] * 8
    with ses.shuffles_dropped(spark), pytest.raises(ZeroDivisionError), ses.shuffles_dropped(spark):
        assert spark.conf.get(ses._CLEAN_UP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(ses._CLEAN_UP) == "false"


def test_scratch_keeps_only_what_is_asked_for(spark):
    with ses.scratch(spark):
        with ses.scratch(spark):
            lost, kept = path_of(ses.staged(spark.range(3))), path_of(ses.staged(spark.range(4), kept=True))
        assert not lost.exists() and kept.exists()
    assert not kept.exists()
    assert path_of(ses.staged(spark.range(3))).exists()


def small_tables(spark, copies=40):
    """Two species; gene and transcript k, each transcript with one coding exon and the same two domains ``copies`` times over."""
    names = ["H_sapiens", "M_musculus"]
    genes = [(k, f"G{k}", None, f"SYM{k}", None, "1", "+", names[k % 2], 0) for k in range(4)]
    tx = [(k, k, f"NM_{k}", None, 0, 900, 0, 900, 1, f"G{k}", None, f"NP_{k}", None, 0) for k in range(4)]
    cds = [(k, k, 1, 0, 900, 1, 900, 1) for k in range(4)]
    proteins = [(k, k, f"NP_{k}", None, None, None, 300, f"NM_{k}", None) for k in range(4)]
    kinds = [("pfam1", 10, "long name", None), ("smart2", 20 , None, "CDD1")]
    domains = [(k, kinds[m][1] + k % 2 * m, 1 + i, 9 + i, kinds[m][0] + str(k % 2 * m), kinds[m][3], kinds[m][2]) for k in range(4) for m in range(2) for i in range(copies)]
    gene = "gene_geneid_id string, gene_ensembl_id string"
    protein = "protein_refseq_id string, protein_ensembl_id string"
    transcript = "transcript_refseq_id string, transcript_ensembl_id string"
    made = {
        "genes": (genes, f"gene_key long, {gene}, gene_symbol string, synonyms string, chromosome string, strand string, specie string, family long"),
        "transcripts": (tx, f"tx_key long, gene_key long, {transcript}, tx_start long, tx_end long, cds_start long, cds_end long, exon_count int, {gene}, {protein}, canonical int"),
        "cds": (cds, "tx_key long, gene_key long, order_in_transcript int, genomic_start_tx long, genomic_end_tx long, abs_start_cds long, abs_end_cds long, coding_rank long"),
        "proteins": (proteins, f"tx_key long, gene_key long, {protein}, description string, synonyms string, length long, {transcript}"),
        "domains": (domains, "tx_key long, type_id long, aa_start long, aa_end long, ext_id string, cdd string, name string"),
    }
    return SimpleNamespace(spark=spark, **{n: spark.createDataFrame(*rows) for n, rows in made.items()})


def test_types_are_numbered_without_reading_events(spark, tmp_path, monkeypatch):
    """Accessions are listed once for each species; events are not read again for every later species."""
    seen = []
    whole = queries_store.ty.number_types
    monkeypatch.setattr(queries_store.ty, "number_types", lambda nodes, ids: seen.append(nodes.inputFiles()) or whole(nodes, ids))
    before = staged_folders(spark)
    columns = []
    add = Store.add
    monkeypatch.setattr(Store, "add", lambda self, *a: columns.extend(c for f in seen[-1] for c in pq.read_schema(f.removeprefix("file://")).names) or add(self, *a))
    store = queries_store.build_store(small_tables(spark), str(tmp_path / "store"))
    assert len(seen) == 5 and columns and not {"tx_key", "aa_start"} & set(columns)
    types = {(r["type_id"], r["name"], r["cdd_id"]) for r in store.load("domain_type").collect()}
    assert types == {(1, "long name", None), (2, None, "CDD1"), (3, None, "CDD1")}
    per = {(r["specie"], r["type_id"]): r["count"] for r in store.load("domain_event").groupBy("specie", "type_id").count().collect()}
    assert per == {("H_sapiens", 1): 80, ("H_sapiens", 2): 80, ("M_musculus", 1): 80, ("M_musculus", 3): 80}
    assert staged_folders(spark) == before  # the store holds all that is needed


def test_items_are_made_once_and_numbered(spark):
    rows = [("a", None, 3, "x"), ("a", None, 1, "y"), ("a", None, 1, "b"), (None, "q", 2, "z"), (None, "q", 2, None), ("a", "q", 5, "w")]
    df = spark.createDataFrame(rows, "k string, m string, at int, what string")
    items = item_rows(df, ["k", "m"], F.concat("what", F.lit("!")), sort_by=[F.col("at")])
    assert items.inputFiles() and all("/staged/" in f for f in items.inputFiles())  # counting and numbering read what was written
    assert sorted(map(tuple, items.collect()), key=str) == [("a", "q", 1, "w!"), ("a", None, 1, "b!"), ("a", None, 2, "y!"), ("a", None, 3, "x!"), (None, "q", 1, "z!")]


def test_hot_keys_are_told_by_hash_and_still_cut(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.lit(None).cast("string").alias("m"), "id", F.lit(1).cast("bigint").alias("one"))
    df = ses.staged(df.filter("k IS NULL OR k = 'k1' OR id < 60"))
    sizes = hot_sizes(df, ["k", "m"], hot_rows=100)
    assert {(r["k"], r["m"], r["n_rows"]) for r in sizes.collect()} == {(None, None, 300), ("k1", None, 300)}
    got = running_by_key(df, ["k", "m"], ["id"], {"n": ("sum", "one", "through")}, sizes, hot_rows=100)
    want = df.withColumn("w", F.count("*").over(Window.partitionBy("k", "m").orderBy("id")))
    assert got.join(want, "id").filter("n <> w").count() == 0 and got.count() == 620
    assert hot_sizes(df, ["k", "m"], hot_rows=1000).count() == 0


def test_events_go_when_their_items_are_written(spark):
    t, before = small_tables(spark, copies=3), staged_folders(spark)
    items = queries_domains.domains_text_items(t)
    assert len(staged_folders(spark) - before) == 1
    assert items.count() == 24 and {"item"} <= set(pq.read_schema(items.inputFiles()[0].removeprefix("file://")).names)
    first = items.filter("protein_refseq_id = 'NP_1'").orderBy("position").collect()
    assert [r["item"] for r in first][:2] == ["long name;pfam10;1-9;1-27", ";smart21;1-9;1-27"] and [r["position"] for r in first] == [1, 2, 3, 4, 5, 6]


def test_texts_are_written_before_proteins_meet_them(spark):
    """The outer join reads one written table of texts; events and items behind it are gone."""
    t, before = small_tables(spark, copies=2), staged_folders(spark)
    joined = queries_domains.outer_join_domains(t)
    made = staged_folders(spark) - before
    assert len(made) == 1 and {"domains_info"} <= set(pq.read_schema(next(made.pop().glob("*.parquet"))).names)
    got = {r["protein_refseq_id"]: r["domains_info"] for r in joined.collect()}
    assert set(got) == {"NP_0", "NP_1", "NP_2", "NP_3"}
    assert got["NP_1"] == "long name;pfam10;1-9;1-27||;smart21;1-9;1-27||long name;pfam10;2-10;4-30||;smart21;2-10;4-30"


def test_reconciling_leaves_only_its_parts(spark):
    """Facts, pairs and unfilled rows are deleted when the three parts are written, and each part is written by itself."""
    refseq = spark.createDataFrame(
        [(1, "NM_1.1", None, "G1", "NP_1.1", 100, 1), (2, "NM_2.1", None, "G2", "NP_2.1", 50, 0), (3, "NM_3.1", None, "G3", None, None, 0)],
        "ord long, transcript_refseq_id string, own_ensembl_id string, gene_geneid_id string, protein_refseq_id string, length long, canonical int",
    )
    ensembl = spark.createDataFrame(
        [(1, "ENST1.1", "ENSG1", "ENSP1.1", 101, 2), (2, "ENST2.1", "ENSG2", "ENSP2.1", 90, 0), (9, "ENST9.1", "ENSG9", None, None, 2)],
        "ord long, transcript_ensembl_id string, gene_ensembl_id string, protein_ensembl_id string, length long, canonical int",
    )
    rows = spark.createDataFrame(
        [("G1", "ENSG1", "NM_1.1", "ENST1.1", "NP_1.1", "ENSP1.1", 1), ("G2", "ENSG2", "NM_2.1", "ENST2.1", "NP_2.1", "ENSP2.1", 2), ("G9", "ENSG9", None, "ENST9.1", None, None, 3)],
        "gene_id string, ens_gene string, refseq_tx string, ens_tx string, refseq_prot string, ens_prot string, ord long",
    )
    before = staged_folders(spark)
    got = rc.reconcile_transcripts(refseq, ensembl, rows)
    assert len(staged_folders(spark) - before) == 3
    assert sorted((r.action, r.transcript_refseq_id, r.transcript_ensembl_id, r.gene_geneid_id, r.gene_ensembl_id, r.protein_refseq_id, r.protein_ensembl_id, r.canonical) for r in got.collect()) == [
        ("fill", "NM_3.1", None, "G3", None, None, None, 0),
        ("kept_apart", None, "ENST2.1", "G2", "ENSG2", None, "ENSP2.1", 0),
        ("leftover", None, "ENST9.1", "G9", "ENSG9", None, None, 2),
        ("merge", "NM_1.1", "ENST1.1", "G1", "ENSG1", "NP_1.1", "ENSP1.1", 3),
        ("separate", "NM_2.1", None, "G2", "ENSG2", "NP_2.1", None, 0),
    ]


def test_types_met_before_are_looked_up_once(spark, monkeypatch):
    """What earlier numbers say of each component is written once and read for both kept and new ids."""
    written = []
    monkeypatch.setattr(ty, "staged", lambda df: written.append(df.columns) or ses.staged(df))
    nodes = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("d", "c2"), ("e", "c0"), (None, "c3")], "node string, component string")
    known = spark.createDataFrame([("b", 4), ("a", 6), ("z", 9)], "ext_id string, type_id long")
    got = sorted(map(tuple, ty.number_types(nodes, known).collect()), key=str)
    assert got == [("a", 4), ("b", 4), ("d", 11), ("e", 10), (None, 12)] and ["component", "_old"] in written


def test_search_keeps_only_its_hits(spark):
    """What was looked up by id and by prefix goes when the hits are written."""
    genes = spark.createDataFrame([(1, "H", "ABC", "11", "ENSG1", "old; abc2"), (2, "M", "XYZ", None, "ENSG2", "abc2")],
                                  "gene_key long, specie string, gene_symbol string, gene_geneid_id string, gene_ensembl_id string, synonyms string")
    tx = spark.createDataFrame([("NM_1.1", "ENST1.1", "11", "ENSG1"), ("NM_12.1", None, None, "ENSG2")],
                               "transcript_refseq_id string, transcript_ensembl_id string, gene_geneid_id string, gene_ensembl_id string")
    tx = tx.withColumns({"protein_refseq_id": F.lit(None).cast("string"), "protein_ensembl_id": F.lit(None).cast("string")})
    terms = spark.createDataFrame([("abc2", "M"), ("nm_1", "all"), ("ENST1.1", "M"), ("nm_1.1", None), ("nm_1", "H")], "term string, species string")
    wanted = {
        False: {("abc2", "M", 4, 2), ("nm_1", "all", 3, 1), ("nm_1", "all", 3, 2), ("nm_1", "H", 3, 1), ("nm_1.1", None, 2, 1)},
        True: {("abc2", "M", 4, 2), ("nm_1", "all", 3, 1), ("nm_1", "all", 3, 2), ("nm_1", "H", 3, 1), ("nm_1.1", None, 2, 1)},
    }
    for first, rows in wanted.items():
        before = staged_folders(spark)
        found = se.search(terms, genes, tx, species_first=first)
        assert len(staged_folders(spark) - before) == 1
        assert {(r["term"], r["species"], r["tier"], r["gene_key"]) for r in found.collect()} == rows and found.count() == len(rows)
    before = staged_folders(spark)
    assert se.find_genes(terms, genes, tx).filter("term = 'nm_1'").count() == 2 and len(staged_folders(spark) - before) == 1
