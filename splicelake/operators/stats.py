"""Content reports and quality checks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.joins import or_join

# Report buckets as (label, lowest, highest).
EXON_COUNT_BUCKETS = (
    ("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5", 5, 5),
    ("6-9", 6, 9), ("10-15", 10, 15), ("16-35", 16, 35), ("36+", 36, None),
)
COUNT_BUCKETS = (
    ("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4", 4, 4), ("5", 5, 5),
    ("6-15", 6, 15), ("16-35", 16, 35), ("36+", 36, None),
)
DOMAIN_SIZE_BUCKETS = (
    ("0-60", 0, 60), ("61-120", 61, 120), ("121-300", 121, 300), ("301-900", 301, 900), ("901+", 901, None),
)


def bucket(value: Column, buckets: Sequence[tuple]) -> Column:
    out = None
    for label, lo, hi in buckets:
        test = value.between(lo, hi) if hi is not None else (value >= lo)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def histogram(df: DataFrame, value: str, buckets: Sequence[tuple], weight: str | None = None) -> DataFrame:
    """Rows per bucket plus a ``total`` row; with ``weight`` the sum of that column instead."""
    n = F.count("*") if weight is None else F.sum(weight)
    labelled = df.withColumn("bucket", bucket(F.col(value), buckets)).filter("bucket IS NOT NULL")
    return labelled.rollup("bucket").agg(n.cast("bigint").alias("n")).select(
        F.coalesce("bucket", F.lit("total")).alias("bucket"), "n"
    )


def exon_count_histogram(transcripts: DataFrame) -> DataFrame:
    """Transcripts with a RefSeq id by number of exons."""
    per_count = transcripts.groupBy("exon_count").agg(F.count("transcript_refseq_id").alias("k"))
    return histogram(per_count, "exon_count", EXON_COUNT_BUCKETS, "k")


def transcripts_per_gene_histogram(transcripts: DataFrame) -> DataFrame:
    """Genes by number of transcripts with a RefSeq id; transcripts without a GeneID count as one gene."""
    per_gene = transcripts.groupBy("gene_geneid_id").agg(F.count("transcript_refseq_id").alias("k"))
    return histogram(per_gene, "k", COUNT_BUCKETS)


def events_per_type_histogram(events: DataFrame) -> DataFrame:
    return histogram(events.groupBy("type_id").agg(F.count("*").alias("k")), "k", COUNT_BUCKETS)


def domain_size_histogram(events: DataFrame) -> DataFrame:
    return histogram(events, "total_length", DOMAIN_SIZE_BUCKETS)


def _counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).cast("bigint").alias(n) for n, c in tests.items()])


def check_spans(transcripts: DataFrame) -> DataFrame:
    """Transcripts with a very short extent, coding span or start UTR, or a coding end past the extent."""
    c = F.col
    return _counts(
        transcripts,
        {
            "short_tx": c("tx_start") + 3 >= c("tx_end"),
            "short_cds": c("cds_start") + 3 >= c("cds_end"),
            "short_utr_start": c("tx_start") + 3 >= c("cds_start"),
            "cds_past_end": c("tx_end") + 3 <= c("cds_end"),
        },
    )


def small_exons(exons: DataFrame) -> DataFrame:
    size = F.col("genomic_end_tx") - F.col("genomic_start_tx")
    return _counts(exons, {"size_0_or_less": size <= 0, **{f"size_{n}": size == n for n in range(1, 5)}})


def small_proteins(proteins: DataFrame) -> DataFrame:
    n = F.col("length")
    return _counts(
        proteins,
        {"size_0_or_less": n <= 0, **{f"size_{k}": n == k for k in range(1, 5)}, "size_5_to_60": n.between(5, 60)},
    )


def gene_summary(genes: DataFrame, transcripts: DataFrame, unique_exons: DataFrame) -> DataFrame:
    """Transcripts, unique exons and the largest exon count of every gene."""
    per_tx = transcripts.groupBy("gene_key").agg(
        F.count("*").alias("transcripts_number"), F.max("exon_count").cast("bigint").alias("max_exons_per_transcript")
    )
    per_ex = unique_exons.groupBy("gene_key").agg(F.count("*").alias("unique_exons_per_gene"))
    return genes.select("gene_key", "gene_symbol").join(per_tx, "gene_key").join(per_ex, "gene_key")


def _with_species(df: DataFrame, genes: DataFrame, geneid: str, ensembl: str) -> DataFrame:
    ids = genes.select(F.col("gene_geneid_id").alias("_g1"), F.col("gene_ensembl_id").alias("_g2"), "specie")
    return or_join(df, ids, (geneid, "_g1"), (ensembl, "_g2")).drop("_g1", "_g2")


def species_counts(genes: DataFrame, transcripts: DataFrame, unique_exons: DataFrame) -> DataFrame:
    """Genes, transcripts and unique exons per species, the last two through either gene id."""
    g = genes.groupBy("specie").agg(F.count("*").alias("genes"))
    tx = transcripts.select("transcript_refseq_id", "transcript_ensembl_id", "gene_geneid_id", "gene_ensembl_id")
    t = (
        _with_species(tx, genes, "gene_geneid_id", "gene_ensembl_id")
        .select("transcript_refseq_id", "transcript_ensembl_id", "specie")
        .distinct()
        .groupBy("specie")
        .agg(F.count("*").alias("transcripts"))
    )
    ex = unique_exons.select("gene_geneid_id", "gene_ensembl_id", "genomic_start_tx", "genomic_end_tx")
    e = (
        _with_species(ex, genes, "gene_geneid_id", "gene_ensembl_id")
        .distinct()
        .groupBy("specie")
        .agg(F.count("*").alias("unique_exons"))
    )
    return g.join(t, "specie").join(e, "specie")


def union_ids_by_species(genes: DataFrame) -> DataFrame:
    """Every gene id of either kind with its species."""
    return (
        genes.select("specie", F.explode(F.array("gene_geneid_id", "gene_ensembl_id")).alias("id")).na.drop().distinct()
    )


def species_domain_stats(genes: DataFrame, transcripts: DataFrame, events: DataFrame, pieces: DataFrame) -> DataFrame:
    """Domain types, domain events and in-domain junctions per species.

    A transcript belongs to a species when either of its gene ids does.
    """
    owned = union_ids_by_species(genes)
    # One row per (transcript, species), whichever of the two ids matched.
    linked = (
        transcripts.select("tx_key", F.explode(F.array("gene_geneid_id", "gene_ensembl_id")).alias("id"))
        .filter("id IS NOT NULL")
        .join(owned, "id")
        .select("tx_key", "specie")
        .distinct()
    )
    coding = transcripts.filter("protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL").select("tx_key")
    of_proteins = events.join(linked.join(coding, "tx_key"), "tx_key")
    per_type = of_proteins.groupBy("specie", "type_id").agg(F.count("*").alias("_n"))
    d = per_type.groupBy("specie").agg(F.count("*").alias("domain_types"), F.sum("_n").alias("domain_events"))
    p = pieces.join(linked, "tx_key").groupBy("specie").agg(F.count("*").alias("in_domain_junctions"))
    return d.join(p, "specie")


def gene_extent(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("gene_key").agg(
        F.min("tx_start").alias("gene_start"), F.max("tx_end").alias("gene_end")
    )


def max_protein_nt(proteins: DataFrame) -> DataFrame:
    return proteins.groupBy("gene_key").agg((F.max("length") * 3).alias("max_protein_nt"))


def type_cut_counts(types: DataFrame, pieces: DataFrame) -> DataFrame:
    """Junction rows of each domain type, 0 for types that are never cut."""
    cut = pieces.groupBy("type_id").agg(F.count("*").alias("n"))
    return types.select("type_id").join(cut, "type_id", "left").select("type_id", F.coalesce("n", F.lit(0)).alias("n"))


def domain_coverage(proteins: DataFrame, events: DataFrame) -> DataFrame:
    space = events.groupBy("tx_key").agg((F.sum("aa_end") - F.sum("aa_start")).alias("domain_space"))
    return proteins.select("tx_key", "length").join(space, "tx_key")


def longest_genes(transcripts: DataFrame, limit: int | None = None) -> DataFrame:
    """Genes by extent, longest first."""
    ranked = gene_extent(transcripts).select("gene_key", (F.col("gene_end") - F.col("gene_start")).alias("extent"))
    ordered = ranked.orderBy(F.desc("extent"), "gene_key")
    return ordered if limit is None else ordered.limit(limit)


def duplicate_symbols(genes: DataFrame) -> DataFrame:
    return genes.groupBy(F.upper("gene_symbol").alias("symbol")).agg(F.count("*").alias("n")).filter("n > 1")
