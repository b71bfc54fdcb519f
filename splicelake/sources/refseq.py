"""RefSeq annotation: genes, transcripts, coding spans and exons from GFF3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.sources.gff3 import attr, attr_list, of_type

# How the files mark what is read or left out.
ALT_NOTE = "Anchor sequence. This sequence is derived from alt loci"
ALT_CHROMOSOME = "ALT_chr"
SKIPPED_CHROMOSOMES = (ALT_CHROMOSOME, "Unknown")
TRANSCRIPT_TYPES = ("mRNA", "lnc_RNA", "transcript")
CANONICAL_TAGS = ("MANE Select", "RefSeq Select")


def seqid_to_chromosome(features: DataFrame) -> DataFrame:
    """(seqid, chromosome); the last named region wins and alternative loci become ``ALT_chr``."""
    named = (
        of_type(features, "region")
        .withColumn("name", F.get(attr_list("Name"), F.lit(0)))
        .filter("name IS NOT NULL")
        .groupBy("seqid")
        .agg(F.max_by("name", "ord").alias("name"))
    )
    alt = of_type(features, "sequence_feature").filter(attr("Note").startswith(ALT_NOTE)).select("seqid").distinct()
    return named.join(alt.withColumn("alt", F.lit(True)), "seqid", "full_outer").select(
        "seqid", F.when(F.col("alt"), ALT_CHROMOSOME).otherwise(F.col("name")).alias("chromosome")
    )


def _located(features: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Features on a named chromosome; alternative and unknown ones are dropped."""
    return features.join(chromosomes, "seqid").filter(~F.col("chromosome").isin(*SKIPPED_CHROMOSOMES))


def _is_copy(feature_id: Column) -> Column:
    """True for ids such as ``gene-ABC-2``: a later copy of the same record."""
    parts = F.split(feature_id, "-")
    return (F.size(parts) > 2) & F.element_at(parts, -1).rlike(r"^\d$")


def _tagged(prefix: str) -> Column:
    """Value of the first Dbxref entry with this prefix."""
    hit = F.get(F.filter(attr_list("Dbxref"), lambda x: x.startswith(prefix)), F.lit(0))
    return F.substr(hit, F.lit(len(prefix) + 1))


def refseq_genes(features: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Protein-coding genes, one row per GeneID; X is preferred to Y, otherwise the first record counts."""
    genes = _located(of_type(features, "gene"), chromosomes).filter(attr("gene_biotype") == "protein_coding")
    rows = genes.filter(~_is_copy(attr("ID"))).select(
        F.split_part(F.get(attr_list("Dbxref"), F.lit(0)), F.lit(":"), F.lit(2)).alias("gene_geneid_id"),
        attr("gene").alias("gene_symbol"),
        F.coalesce(F.array_join(attr_list("gene_synonym"), "; "), F.lit(" ")).alias("synonyms"),
        "chromosome",
        "strand",
        "ord",
    ).withColumn("synonyms", F.when(F.col("synonyms") == "", F.lit(" ")).otherwise(F.col("synonyms")))
    first = rows.groupBy("gene_geneid_id").agg(
        F.min_by(F.struct("gene_symbol", "synonyms", "chromosome", "strand"), "ord").alias("f"),
        F.min_by(
            F.struct("gene_symbol", "synonyms", "chromosome", "strand"),
            F.when(F.col("chromosome") == "X", F.col("ord")),
        ).alias("x"),
    )
    pick = F.when((F.col("f.chromosome") == "Y") & F.col("x").isNotNull(), F.col("x")).otherwise(F.col("f"))
    return first.select("gene_geneid_id", pick.alias("g")).select("gene_geneid_id", "g.*")


def refseq_transcripts(features: DataFrame, chromosomes: DataFrame, genes: DataFrame) -> DataFrame:
    """Transcripts of known genes on the gene's own chromosome; the last record of an id counts."""
    rows = _located(of_type(features, *TRANSCRIPT_TYPES), chromosomes).filter(~_is_copy(attr("ID")))
    tags = attr_list("tag")
    canonical = F.exists(tags, lambda t: t.isin(*CANONICAL_TAGS))
    shaped = rows.select(
        attr("transcript_id").alias("transcript_refseq_id"),
        _tagged("Ensembl:").alias("own_ensembl_id"),
        _tagged("GeneID:").alias("gene_geneid_id"),
        "chromosome",
        "seqid",
        "strand",
        (F.col("start") - 1).alias("tx_start"),
        F.col("end").alias("tx_end"),
        canonical.cast("int").alias("canonical"),
        "ord",
    ).filter("transcript_refseq_id IS NOT NULL AND gene_geneid_id IS NOT NULL")
    known = shaped.join(genes.select("gene_geneid_id", "chromosome"), ["gene_geneid_id", "chromosome"])
    rest = [c for c in known.columns if c not in ("transcript_refseq_id", "ord")]
    return (
        known.groupBy("transcript_refseq_id")
        .agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("ord"))
        .select("transcript_refseq_id", "r.*", "ord")
    )


def genes_with_transcripts(genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    return genes.join(transcripts, "gene_geneid_id", "left_semi")


def refseq_cds(features: DataFrame, chromosomes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Coding span and protein of each transcript: smallest start - 1, largest end, last protein name."""
    rows = _located(of_type(features, "CDS"), chromosomes).filter("chromosome <> 'MT'")
    parent = F.get(attr_list("Parent"), F.lit(0))
    owner = F.split_part(parent, F.lit("-"), F.lit(2))
    return (
        rows.filter(parent.startswith("rna-"))
        .select(owner.alias("transcript_refseq_id"), attr("Name").alias("protein"), "start", "end", "ord")
        .join(transcripts.select("transcript_refseq_id"), "transcript_refseq_id", "left_semi")
        .groupBy("transcript_refseq_id")
        .agg(
            (F.min("start") - 1).alias("cds_start"),
            F.max("end").alias("cds_end"),
            F.max_by("protein", "ord").alias("protein_refseq_id"),
        )
    )


def mito_transcripts(features: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Single-exon transcripts ``mito-<GeneID>`` made from mitochondrial coding records; starts stay 1-based."""
    rows = _located(of_type(features, "CDS"), chromosomes).filter("chromosome = 'MT'")
    shaped = rows.select(
        F.concat(F.lit("mito-"), _tagged("GeneID:")).alias("transcript_refseq_id"),
        _tagged("Ensembl:").alias("own_ensembl_id"),
        _tagged("GeneID:").alias("gene_geneid_id"),
        "chromosome",
        "strand",
        F.col("start").alias("tx_start"),
        F.col("end").alias("tx_end"),
        F.col("start").alias("cds_start"),
        F.col("end").alias("cds_end"),
        attr("Name").alias("protein_refseq_id"),
        "ord",
    )
    rest = [c for c in shaped.columns if c not in ("transcript_refseq_id", "ord")]
    return shaped.groupBy("transcript_refseq_id").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select(
        "transcript_refseq_id", "r.*"
    )


def refseq_exons(features: DataFrame, chromosomes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Exons on their transcript's own sequence; the order is the third part of the exon id."""
    parts = F.split(attr("ID"), "-")
    rows = _located(of_type(features, "exon"), chromosomes).filter(F.size(parts) == 3)
    return (
        rows.select(
            F.get(parts, F.lit(1)).alias("transcript_refseq_id"),
            "seqid",
            F.get(parts, F.lit(2)).cast("int").alias("order_in_transcript"),
            (F.col("start") - 1).alias("genomic_start_tx"),
            F.col("end").alias("genomic_end_tx"),
        )
        .join(transcripts.select("transcript_refseq_id", "seqid"), ["transcript_refseq_id", "seqid"], "left_semi")
        .drop("seqid")
    )


def require_protein(transcripts: DataFrame, trans2pro: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): transcripts with and without a record in the protein files."""
    known = trans2pro.select(F.col("id").alias("transcript_refseq_id"))
    return (
        transcripts.join(known, "transcript_refseq_id", "left_semi"),
        transcripts.join(known, "transcript_refseq_id", "left_anti"),
    )
