"""Transcripts and exons: order, coding coordinates, usage, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import coords, ids
from splicelake.operators.lists import group_text
from splicelake.operators.ordered import running, running_by_key


def exons_to_cds(exons: DataFrame, transcripts: DataFrame, key: str = "tx_key", sizes: DataFrame | None = None) -> DataFrame:
    """Coding coordinates of every exon.

    Adds ``abs_start_cds`` / ``abs_end_cds`` (1-based, closed, (0,0) for an exon
    outside the coding span) and ``coding_rank``, the exon's number among the
    coding exons of its transcript. A transcript without a coding span uses its
    own extent. ``sizes`` (``key``, ``n_rows``) tells the exons of each transcript, where they are known or cheap to
    count; ordinary transcripts then go through one shuffle only.
    """
    spans = transcripts.select(
        key,
        coords.cds_or_tx(F.col("cds_start"), F.col("tx_start")).alias("_cs"),
        coords.cds_or_tx(F.col("cds_end"), F.col("tx_end")).alias("_ce"),
    )
    clipped = exons.join(spans, key).withColumn(
        "_len",
        coords.coding_length(F.col("genomic_start_tx"), F.col("genomic_end_tx"), F.col("_cs"), F.col("_ce")),
    )
    clipped = clipped.withColumn("_coding", (F.col("_len") > 0).cast("int")).drop("_cs", "_ce")
    order, sums = ["order_in_transcript"], {"_cum": ("sum", "_len", "through"), "coding_rank": ("sum", "_coding", "through")}
    scanned = running(clipped, [key], order, sums) if sizes is None else running_by_key(clipped, [key], order, sums, sizes)
    coding = F.col("_len") > 0
    return scanned.select(
        *exons.columns,
        F.when(coding, F.col("_cum") - F.col("_len") + 1).otherwise(0).cast("bigint").alias("abs_start_cds"),
        F.when(coding, F.col("_cum")).otherwise(0).cast("bigint").alias("abs_end_cds"),
        F.when(coding, F.col("coding_rank")).otherwise(0).cast("bigint").alias("coding_rank"),
    )


def exon_counts(exons: DataFrame, key: str = "tx_key") -> DataFrame:
    return exons.groupBy(key).agg(F.count("*").alias("exon_count"))


def order_exons(exons: DataFrame, key: str, order: list[str]) -> DataFrame:
    """1-based order of exons in their transcript plus the number of them."""
    numbered = running(
        exons.withColumn("_one", F.lit(1).cast("bigint")),
        [key],
        order,
        {"order_in_transcript": ("sum", "_one", "through")},
    ).drop("_one")
    return numbered.join(exon_counts(exons, key), key)


def unique_exons(exons: DataFrame, keys: list[str]) -> DataFrame:
    return exons.select(*keys).distinct()


def coding_transcripts(transcripts: DataFrame, *, reviewed_only: bool = False) -> DataFrame:
    """Transcripts with a protein; optionally only reviewed (``NM``) or Ensembl-only ones."""
    coding = transcripts.filter("protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL")
    if reviewed_only:
        coding = coding.filter(
            F.col("transcript_refseq_id").isNull() | F.col("transcript_refseq_id").startswith("NM")
        )
    return coding


def exon_usage(cds: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One row per gene and coding limits, with the transcripts that use them.

    ``group_no`` numbers the groups of a gene by position. The transcripts of one
    group are listed in id order.
    """
    users = coding_transcripts(transcripts).select(
        "tx_key",
        "cds_start",
        "cds_end",
        ids.preferred_id(F.col("transcript_refseq_id"), F.col("transcript_ensembl_id")).alias("transcript_id"),
    )
    limits = coords.coding_limits(
        F.col("genomic_start_tx"), F.col("genomic_end_tx"), F.col("abs_start_cds"), F.col("cds_start"), F.col("cds_end")
    )
    used = cds.join(users, "tx_key").select(
        "gene_key", "transcript_id", *[c.alias(n) for n, c in limits.items()]
    )
    group_keys = ["gene_key", "lim_start", "lim_end"]
    groups = used.groupBy(*group_keys).agg(
        F.count("*").alias("n_transcripts"), F.lit(1).cast("bigint").alias("_one")
    )
    numbered = running(
        groups,
        ["gene_key"],
        ["lim_start", "lim_end"],
        {"group_no": ("sum", "_one", "through")},
    ).drop("_one")
    names = group_text(used, group_keys, F.col("transcript_id"), ", ", "transcripts")
    return numbered.join(names, group_keys)


def region_view(
    exons: DataFrame, transcripts: DataFrame, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Exons that touch a window of their gene; without limits the window is the whole gene."""
    extent = transcripts.groupBy("gene_key").agg(
        F.min("tx_start").alias("gene_start"), F.max("tx_end").alias("gene_end")
    )
    windows = extent.select(
        "gene_key",
        (F.col("gene_start") if start is None else start).alias("window_start"),
        (F.col("gene_end") if end is None else end).alias("window_end"),
    )
    return exons.join(windows, "gene_key").filter(
        coords.overlaps(
            F.col("genomic_start_tx"), F.col("genomic_end_tx"), F.col("window_start"), F.col("window_end")
        )
    )


def first_long_gap(exons: DataFrame, threshold: int = 1_000_000, key: str = "gene_key") -> DataFrame:
    """First stretch longer than ``threshold`` with no exon, per gene."""
    spans = exons.select(key, "genomic_start_tx", "genomic_end_tx").distinct()
    scanned = running(
        spans,
        [key],
        ["genomic_start_tx", "genomic_end_tx"],
        {"prev_end": ("max", "genomic_end_tx", "before")},
    )
    gaps = scanned.filter(F.col("genomic_start_tx") > F.col("prev_end") + threshold)
    return gaps.groupBy(key).agg(
        F.min("prev_end").alias("gap_start"),
        F.min_by(F.col("genomic_start_tx") - F.col("prev_end"), F.col("prev_end")).alias("gap_length"),
    )
