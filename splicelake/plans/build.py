"""The database build: source files of one species to the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from splicelake.functions import ids, text
from splicelake.operators import domains as dom
from splicelake.operators import exons as ex
from splicelake.operators import idmapping, orthology
from splicelake.operators import reconcile as rc
from splicelake.operators import types as ty
from splicelake.operators.crosswalk import clean_crosswalk
from splicelake.operators.joins import insert_or_ignore
from splicelake.schemas import SPECIES
from splicelake.session import staged
from splicelake.sinks.store import Store
from splicelake.sinks.tables import conform, write_table
from splicelake.sources import ensembl, flatfile, interpro, refseq, tables
from splicelake.sources.gff3 import read_gff3


@dataclass(frozen=True)
class SpeciesInputs:
    """Paths of the source files of one species."""

    species: str
    refseq_gff: str
    protein_flatfile: str
    ensembl_gff: str
    domain_folder: str
    crosswalk: str


def read_refseq(spark: SparkSession, paths: SpeciesInputs) -> dict[str, DataFrame]:
    """Genes, transcripts, exons, proteins and regions of the RefSeq side."""
    features = read_gff3(spark, paths.refseq_gff)
    chromosomes = refseq.seqid_to_chromosome(features)
    coding_genes = refseq.refseq_genes(features, chromosomes)
    tx = refseq.refseq_transcripts(features, chromosomes, coding_genes)
    mito = refseq.mito_transcripts(features, chromosomes).withColumns(
        {"canonical": F.lit(0), "seqid": F.lit(None).cast("string")}
    )
    spans = refseq.refseq_cds(features, chromosomes, tx)
    records = flatfile.read_protein_flatfile(spark, paths.protein_flatfile)
    proteins = staged(flatfile.proteins(records))
    mates = flatfile.trans2pro(proteins)
    kept, _ = refseq.require_protein(tx, mates)
    spanned = kept.join(spans, "transcript_refseq_id", "left").select(
        *[F.col(c) for c in mito.columns]
    )
    transcripts = staged(spanned.unionByName(mito))
    exons = refseq.refseq_exons(features, chromosomes, tx).unionByName(
        mito.select(
            "transcript_refseq_id",
            F.lit(1).alias("order_in_transcript"),
            F.col("tx_start").alias("genomic_start_tx"),
            F.col("tx_end").alias("genomic_end_tx"),
        )
    )
    return {
        "genes": refseq.genes_with_transcripts(coding_genes, transcripts),
        "transcripts": transcripts,
        "exons": exons,
        "proteins": proteins,
        "trans2pro": mates,
        "regions": flatfile.regions(records),
    }


def read_ensembl(spark: SparkSession, paths: SpeciesInputs) -> dict[str, DataFrame]:
    """The same of the Ensembl side; protein lengths follow from the coding coordinates."""
    features = read_gff3(spark, paths.ensembl_gff)
    genes = ensembl.ensembl_genes(features)
    tx = ensembl.ensembl_transcripts(features, genes)
    transcripts = staged(tx.join(ensembl.ensembl_cds(features, tx), "transcript_ensembl_id", "left"))
    exons = staged(ensembl.ensembl_exons(features, tx))
    domains, pairs = tables.read_domain_tables(spark, paths.domain_folder, paths.species)
    coding = ex.exons_to_cds(exons, transcripts, "transcript_ensembl_id")
    proteins, kept, _ = ensembl.ensembl_proteins(pairs, transcripts, coding, domains)
    return {
        "genes": ensembl.genes_with_transcripts(genes, transcripts),
        "transcripts": transcripts,
        "exons": exons,
        "proteins": staged(proteins),
        "domains": kept,
    }


def merge_sources(r: dict[str, DataFrame], e: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """Reconciled transcripts with the extent and coding span of the record each is built on."""
    lengths = r["proteins"].select("protein_refseq_id", "length")
    named = r["transcripts"].join(
        r["trans2pro"].select(F.col("id").alias("transcript_refseq_id"), F.col("other").alias("_flat")), "transcript_refseq_id", "left"
    ).withColumn("protein_refseq_id", F.coalesce("protein_refseq_id", "_flat"))
    a = named.join(lengths, "protein_refseq_id", "left").select(
        F.col("transcript_refseq_id").alias("ord"), "transcript_refseq_id", "own_ensembl_id", "gene_geneid_id", "protein_refseq_id", "length", "canonical"
    )
    known = e["proteins"].groupBy("transcript_ensembl_id").agg(
        F.min_by(F.struct("protein_ensembl_id", "length"), "protein_ensembl_id").alias("p")
    )
    b = e["transcripts"].drop("protein_ensembl_id").join(known, "transcript_ensembl_id", "left").select(
        F.col("transcript_ensembl_id").alias("ord"), "transcript_ensembl_id", "gene_ensembl_id",
        F.col("p.protein_ensembl_id").alias("protein_ensembl_id"), F.col("p.length").alias("length"), "canonical",
    )
    merged = rc.reconcile_transcripts(a, b, rows)
    span = ["chromosome", "strand", "tx_start", "tx_end", "cds_start", "cds_end"]
    by_ref = merged.filter("ref_tx IS NOT NULL").join(r["transcripts"].select(F.col("transcript_refseq_id").alias("ref_tx"), *span), "ref_tx")
    by_ens = merged.filter("ref_tx IS NULL").join(e["transcripts"].select(F.col("transcript_ensembl_id").alias("ens_tx"), *span), "ens_tx")
    keyed = by_ref.withColumn("tx_key", F.concat(F.lit("r:"), "ref_tx")).unionByName(by_ens.withColumn("tx_key", F.concat(F.lit("e:"), "ens_tx")))
    return staged(
        keyed.withColumns(
            {
                "gene_key": F.coalesce("gene_geneid_id", "gene_ensembl_id"),
                "cds_start": F.coalesce("cds_start", "tx_start"),
                "cds_end": F.coalesce("cds_end", "tx_end"),
            }
        ).drop("seq")
    )


def keyed_tables(
    spark: SparkSession,
    paths: SpeciesInputs,
    entry_index: DataFrame,
    previous_types: DataFrame | None = None,
    events: str = "all",
    earlier_facts: DataFrame | None = None,
    verdicts: Observation | None = None,
) -> dict[str, DataFrame]:
    """All tables of one species with the build's own keys, and the facts its domain types rest on.

    ``previous_types`` is (ext_id, type_id) of an earlier build; its type ids are kept. With ``earlier_facts``, those
    of other species, a domain also belongs to an earlier type when only those facts link the two. ``verdicts`` gets the
    counts of kept and dropped domains from the pass that labels them.
    """
    r, e = read_refseq(spark, paths), read_ensembl(spark, paths)
    rows = clean_crosswalk(tables.read_id_crosswalk(spark, paths.crosswalk), SPECIES[paths.species][3])
    tx = merge_sources(r, e, rows)

    place = ["order_in_transcript", "genomic_start_tx", "genomic_end_tx"]
    owner = tx.select("tx_key", "gene_key", "exon_source", "ref_tx", "ens_tx")
    exons = staged(
        owner.filter("exon_source = 'refseq'").join(r["exons"].withColumnRenamed("transcript_refseq_id", "ref_tx"), "ref_tx")
        .select("tx_key", "gene_key", *place)
        .unionByName(
            owner.filter("exon_source = 'ensembl'").join(e["exons"].withColumnRenamed("transcript_ensembl_id", "ens_tx"), "ens_tx")
            .select("tx_key", "gene_key", *place)
        )
    )
    cds = staged(ex.exons_to_cds(exons, tx))

    # Proteins: the RefSeq record leads; the Ensembl record adds its description.
    ref_prot = r["proteins"].select(
        F.col("protein_refseq_id").alias("_rp"), F.col("description").alias("_rd"), F.col("synonyms").alias("synonyms"), F.col("length").alias("_rl")
    )
    ens_prot = e["proteins"].select(F.col("protein_ensembl_id").alias("_ep"), F.col("description").alias("_ed"), F.col("length").alias("_el"))
    proteins = staged(
        tx.join(ref_prot, F.col("protein_refseq_id") == F.col("_rp"), "left")
        .join(ens_prot, F.col("ens_prot") == F.col("_ep"), "left")
        .filter("_rp IS NOT NULL OR _ep IS NOT NULL")
        .select(
            "tx_key", "gene_key", "protein_refseq_id", "protein_ensembl_id",
            text.merge_description(F.col("_rd"), F.col("_ed")).alias("description"), "synonyms",
            F.when(F.col("ref_tx").isNotNull(), F.coalesce("_rl", "_el")).otherwise(F.coalesce("_el", "_rl")).alias("length"),
            "transcript_refseq_id", "transcript_ensembl_id",
        )
    )

    # Domains of both sources under stored accessions; equal ones are one.
    regions, _ = ids.normalize_ext_id(r["regions"], "ext_id", "cdd")
    shape = ["tx_key", "ext_id", "aa_start", "aa_end", "name", "note", "cdd"]
    from_ref = regions.withColumn("ext_id", F.col("ext_norm")).withColumnRenamed("protein_refseq_id", "_p").join(
        tx.select("tx_key", F.col("protein_refseq_id").alias("_p")), "_p"
    ).select(*shape)
    listed, _ = ids.normalize_ext_id(e["domains"].withColumn("cdd", F.lit(None).cast("string")), "ext_id")
    from_ens = listed.withColumn("ext_id", F.col("ext_norm")).withColumnRenamed("protein_ensembl_id", "_p").join(
        tx.select("tx_key", F.col("ens_prot").alias("_p")), "_p"
    ).select(*shape)
    united = (
        from_ref.unionByName(from_ens)
        .filter("ext_id IS NOT NULL")
        .groupBy("tx_key", "ext_id", "aa_start", "aa_end")
        .agg(*[F.min(c).alias(c) for c in ("name", "note", "cdd")])
    )
    labelled = ty.eligible_domains(united.withColumnRenamed("note", "own_note"), entry_index)
    judged = staged(labelled if verdicts is None else ty.observe_verdicts(labelled, verdicts))
    usable = judged.filter("verdict IN ('used', 'name_only')")
    facts = usable.select("ext_id", "accession", "cdd", "name", F.concat_ws("; ", "own_note", "note").alias("note")).distinct().withColumn(
        "note", F.nullif(F.col("note"), F.lit(""))
    )
    linked = facts if earlier_facts is None else facts.unionByName(earlier_facts.select(*facts.columns)).distinct()
    numbered = staged(ty.number_types(ty.resolve_domain_types(ty.type_edges(linked)), previous_types))
    types = ty.type_attributes(facts.join(numbered, "ext_id"))

    used = staged(
        judged.filter("verdict = 'used'").join(numbered, "ext_id").select("tx_key", "type_id", "aa_start", "aa_end", "ext_id", "accession")
    )
    shown = used.withColumn("ext_id", F.concat_ws("; ", "ext_id", "accession")).drop("accession")
    placed = dom.domain_events(shown, cds, events)
    event_columns = ["tx_key", "type_id", "aa_start", "aa_end", "nuc_start", "nuc_end", "total_length", "ext_id", "splice_junction", "complete_exon"]
    event_rows = staged(dom.collapse_events(placed.select(*event_columns)))
    pieces = dom.splice_in_domains(used.select("tx_key", "type_id", "aa_start", "aa_end").distinct(), cds)

    genes, unresolved = rc.recover_missing_genes(
        tx, _merged_genes(r, e, tx), r["genes"].withColumn("gene_ensembl_id", F.lit(None).cast("string")),
        e["genes"].withColumns({"gene_geneid_id": F.lit(None).cast("string"), "synonyms": F.lit(None).cast("string")}),
    )
    tx_ids = tx.select("tx_key", "transcript_refseq_id", "transcript_ensembl_id")
    prot_ids = proteins.select("tx_key", "protein_refseq_id", "protein_ensembl_id")
    gene_ids = tx.select("tx_key", "gene_geneid_id", "gene_ensembl_id")
    species = F.lit(paths.species)
    counts = ex.exon_counts(exons).withColumn("exon_count", F.col("exon_count").cast("int"))
    out = {
        "genes": genes.withColumns({"specie": species, "gene_key": F.coalesce("gene_geneid_id", "gene_ensembl_id")}),
        "transcripts": tx.join(counts, "tx_key", "left"),
        "exons": exons.join(gene_ids, "tx_key").select("gene_geneid_id", "gene_ensembl_id", "genomic_start_tx", "genomic_end_tx").distinct(),
        "transcript_exon": cds.join(tx_ids, "tx_key"),
        "proteins": proteins,
        "domain_type": types,
        "domain_event": event_rows.join(prot_ids, "tx_key"),
        "splice_in_domains": pieces.join(tx_ids, "tx_key").withColumnsRenamed(
            {"exon_order": "exon_order_in_transcript", "nuc_start": "domain_nuc_start"}
        ),
        "unresolved_genes": unresolved,
        "type_facts": facts.join(numbered, "ext_id"),
    }
    return out


def species_tables(
    spark: SparkSession, paths: SpeciesInputs, entry_index: DataFrame, previous_types: DataFrame | None = None, events: str = "all"
) -> dict[str, DataFrame]:
    """All stored tables of one species, keyed by table name."""
    out = keyed_tables(spark, paths, entry_index, previous_types, events)
    del out["type_facts"]
    species = F.lit(paths.species)
    return {
        name: df if name == "unresolved_genes" else _tagged(conform(df, name), name, species) for name, df in out.items()
    }


def _tagged(df: DataFrame, name: str, species) -> DataFrame:
    return df if name in ("genes", "domain_type") else df.withColumn("specie", species)


def _merged_genes(r: dict[str, DataFrame], e: dict[str, DataFrame], tx: DataFrame) -> DataFrame:
    """Genes of the merged transcripts: RefSeq rows under their paired Ensembl gene, then the Ensembl rows."""
    pairs = tx.filter("gene_geneid_id IS NOT NULL").groupBy("gene_geneid_id").agg(F.min("gene_ensembl_id").alias("gene_ensembl_id"))
    a = r["genes"].join(pairs, "gene_geneid_id", "left")
    a = insert_or_ignore(a, ["gene_ensembl_id"], ["gene_geneid_id"])
    b = e["genes"].withColumns({"gene_geneid_id": F.lit(None).cast("string"), "synonyms": F.lit(None).cast("string")})
    return rc.merge_genes(a, b)


def build_species(
    spark: SparkSession, paths: SpeciesInputs, entries: str, out: str, previous_types: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Read, merge and write one species; fails when a transcript has no gene."""
    index = staged(interpro.entry_index(interpro.read_entry_list(spark, entries)))
    built = species_tables(spark, paths, index, previous_types)
    lost = built.pop("unresolved_genes").limit(1).count()
    if lost:
        raise ValueError(f"{paths.species}: some transcripts refer to a gene that no source has")
    for name, df in built.items():
        write_table(df, f"{out}/{paths.species}", name, by_species=False)
    return built


def build_merged(
    spark: SparkSession, inputs: list[SpeciesInputs], entries: str, out: str, *, apart: tuple[str, ...] = (), orthology_pairs: str | None = None
) -> Store:
    """The store of all species in ``out/merged``, and one store for each species in ``apart``.

    Species are added one after the other: the types of those before give their ids to the same domains of the
    next. Orthology is added at the end, over the genes of all.
    """
    index = staged(interpro.entry_index(interpro.read_entry_list(spark, entries)))
    store = Store(spark, f"{out}/merged")
    for paths in inputs:
        built = keyed_tables(spark, paths, index, store.type_ids(), earlier_facts=store.load("type_facts"))
        if built.pop("unresolved_genes").limit(1).count():
            raise ValueError(f"{paths.species}: some transcripts refer to a gene that no source has")
        facts = staged(built.pop("type_facts"))
        store.add(paths.species, built, facts)
        if paths.species in apart:
            Store(spark, f"{out}/{paths.species}").add(paths.species, built, facts)
    if orthology_pairs is not None:
        pairs = orthology.orthology_pairs(tables.read_orthology_pairs(spark, orthology_pairs), store.load("genes"))
        store.put("orthology", orthology.collapse_orthology(pairs))
    return store


def build_orthology(spark: SparkSession, pair_folder: str, genes: DataFrame, out: str) -> DataFrame:
    """Orthology table over the genes of all species."""
    pairs = orthology.orthology_pairs(tables.read_orthology_pairs(spark, pair_folder), genes)
    table = orthology.collapse_orthology(pairs)
    write_table(conform(table, "orthology"), out, "orthology", by_species=False)
    return table


def build_representative_domains(
    spark: SparkSession, mapping: str, matches: str, entries: str, proteins: DataFrame, out: str, strategy: str = "ensembl"
) -> tuple[DataFrame, DataFrame]:
    """(proteins with their accession, representative domains of those proteins)."""
    keyed = proteins.withColumn("protein_key", F.struct("protein_refseq_id", "protein_ensembl_id"))
    named = staged(
        idmapping.set_interpro_ids(
            keyed.drop("protein_interpro_id"), interpro.read_uniprot_idmap(spark, mapping), strategy
        ).drop("protein_key")
    )
    found = interpro.representative_domains(
        interpro.read_interpro_matches(spark, matches), named, interpro.read_interpro_descriptions(spark, entries)
    )
    write_table(conform(found, "representative_domains"), out, "representative_domains", by_species=False)
    return named, found
