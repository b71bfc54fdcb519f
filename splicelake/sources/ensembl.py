"""Ensembl annotation: genes, transcripts, coding spans, exons and proteins from GFF3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.sources.gff3 import attr, attr_list, of_type

# Chromosome names, transcript types, tags and texts of the source.
CHROMOSOME_PREFIX = r"(?i)^(\d{1,2}|x|y|MT)"
CHROMOSOME_WHOLE = r"(?i)^(\d{1,2}|x|y|MT)$"
TRANSCRIPT_TYPES = ("mRNA", "lnc_RNA", "transcript")
NMD_BIOTYPE = "nonsense_mediated_decay"
NMD_TEXT = "Nonsense Mediated Decay (NMD)"
CANONICAL_TAG = "Ensembl_canonical"


def on_chromosome(features: DataFrame, *, strict: bool = False) -> DataFrame:
    """Features of the assembled chromosomes, by prefix of the sequence name unless ``strict``."""
    return features.filter(F.col("seqid").rlike(CHROMOSOME_WHOLE if strict else CHROMOSOME_PREFIX))


def ensembl_genes(features: DataFrame, *, strict: bool = False) -> DataFrame:
    rows = on_chromosome(of_type(features, "gene"), strict=strict)
    shaped = rows.select(
        attr("gene_id").alias("gene_ensembl_id"),
        F.coalesce(F.get(attr_list("Name"), F.lit(0)), attr("gene_id")).alias("gene_symbol"),
        F.col("seqid").alias("chromosome"),
        "strand",
        "ord",
    )
    return shaped.groupBy("gene_ensembl_id").agg(
        F.max_by(F.struct("gene_symbol", "chromosome", "strand"), "ord").alias("r")
    ).select("gene_ensembl_id", "r.*")


def _parent(kind: str) -> Column:
    first = F.get(attr_list("Parent"), F.lit(0))
    return F.when(first.startswith(f"{kind}:"), F.substr(first, F.lit(len(kind) + 2)))


def ensembl_transcripts(features: DataFrame, genes: DataFrame, *, strict: bool = False) -> DataFrame:
    rows = on_chromosome(of_type(features, *TRANSCRIPT_TYPES), strict=strict)
    return rows.select(
        F.concat_ws(".", attr("transcript_id"), attr("version")).alias("transcript_ensembl_id"),
        attr("transcript_id").alias("bare_id"),
        F.split_part(F.get(attr_list("Parent"), F.lit(0)), F.lit(":"), F.lit(2)).alias("gene_ensembl_id"),
        F.col("seqid").alias("chromosome"),
        "strand",
        (F.col("start") - 1).alias("tx_start"),
        F.col("end").alias("tx_end"),
        (attr("biotype") == NMD_BIOTYPE).alias("nmd"),
        F.when(F.array_contains(attr_list("tag"), CANONICAL_TAG), 2).otherwise(0).alias("canonical"),
        "ord",
    ).join(genes.select("gene_ensembl_id"), "gene_ensembl_id", "left_semi")


def genes_with_transcripts(genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    return genes.join(transcripts, "gene_ensembl_id", "left_semi")


def ensembl_cds(features: DataFrame, transcripts: DataFrame, *, strict: bool = False) -> DataFrame:
    """Coding span: smallest start - 1 and largest end; the first segment names the protein."""
    rows = on_chromosome(of_type(features, "CDS"), strict=strict)
    return (
        rows.select(_parent("transcript").alias("bare_id"), attr("protein_id").alias("protein"), "start", "end", "ord")
        .join(transcripts.select("bare_id", "transcript_ensembl_id"), "bare_id")
        .groupBy("transcript_ensembl_id")
        .agg(
            (F.min("start") - 1).alias("cds_start"),
            F.max("end").alias("cds_end"),
            F.min_by("protein", "ord").alias("protein_ensembl_id"),
        )
    )


def ensembl_exons(features: DataFrame, transcripts: DataFrame, *, strict: bool = False) -> DataFrame:
    rows = on_chromosome(of_type(features, "exon"), strict=strict)
    return (
        rows.select(
            _parent("transcript").alias("bare_id"),
            attr("rank").cast("int").alias("order_in_transcript"),
            (F.col("start") - 1).alias("genomic_start_tx"),
            F.col("end").alias("genomic_end_tx"),
        )
        .join(transcripts.select("bare_id", "transcript_ensembl_id"), "bare_id")
        .drop("bare_id")
    )


def ensembl_proteins(
    pro2trans: DataFrame, transcripts: DataFrame, cds: DataFrame, domains: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proteins, their domains, counts).

    ``pro2trans`` is (protein_ensembl_id, transcript_ensembl_id); ``cds`` has
    coding coordinates per transcript. A protein whose transcript was not read is
    dropped with its domains. An id without a version raises an error when the
    proteins are computed.
    """
    coding = cds.groupBy("transcript_ensembl_id").agg(F.max("abs_end_cds").alias("_end"))
    length = F.floor(F.col("_end") / F.lit(3.0) - 1).cast("bigint")
    linked = pro2trans.join(transcripts.select("transcript_ensembl_id", "nmd"), "transcript_ensembl_id", "left")
    found = linked.filter("nmd IS NOT NULL").join(coding, "transcript_ensembl_id", "left")
    checked = F.when(F.col("protein_ensembl_id").contains("."), F.col("protein_ensembl_id")).otherwise(
        F.raise_error(F.concat(F.lit("protein without version: "), F.col("protein_ensembl_id")))
    )
    # int() rounds towards zero, so a coding end below 3 gives 0 and not -1.
    proteins = found.select(
        checked.alias("protein_ensembl_id"),
        "transcript_ensembl_id",
        F.when(F.col("nmd"), NMD_TEXT).alias("description"),
        F.greatest(F.lit(0), length).alias("length"),
    )
    kept = domains.join(found.select("protein_ensembl_id"), "protein_ensembl_id", "left_semi")
    counts = linked.agg(
        F.count_if(F.col("nmd").isNotNull()).alias("found"), F.count_if(F.col("nmd").isNull()).alias("not_found")
    )
    return proteins, kept, counts
