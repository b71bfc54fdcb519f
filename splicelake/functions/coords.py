"""Coordinate arithmetic: genomic, coding and amino-acid positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nuc_start(aa_start: Column) -> Column:
    return aa_start * 3 - 2


def nuc_end(aa_end: Column) -> Column:
    return aa_end * 3


def aa_to_nuc(aa_start: Column, aa_end: Column, name: Column) -> dict[str, Column]:
    """Coding positions of an amino-acid interval; a missing end marks the row as an error."""
    broken = aa_start.isNull() | aa_end.isNull()
    return {
        "nuc_start": F.when(broken, F.lit(0)).otherwise(nuc_start(aa_start)).cast("bigint"),
        "nuc_end": F.when(broken, F.lit(0)).otherwise(nuc_end(aa_end)).cast("bigint"),
        "name": F.when(broken, F.concat(F.lit("Error_"), F.coalesce(name, F.lit("None")))).otherwise(name),
    }


def coding_length(start: Column, end: Column, cds_start: Column, cds_end: Column) -> Column:
    """Length of a half-open exon inside the coding span."""
    return F.greatest(F.lit(0), F.least(end, cds_end) - F.greatest(start, cds_start))


def cds_or_tx(cds: Column, tx: Column) -> Column:
    return F.coalesce(cds, tx)


def utr_flags(start: Column, end: Column, abs_start: Column, cds_start: Column, cds_end: Column) -> dict[str, Column]:
    coding = abs_start != 0
    return {
        "is_utr_all": abs_start == 0,
        "utr_start_offset": F.when(coding & cds_start.between(start, end), cds_start - start),
        "utr_end_offset": F.when(coding & cds_end.between(start, end), end - cds_end),
    }


def coding_limits(start: Column, end: Column, abs_start: Column, cds_start: Column, cds_end: Column) -> dict[str, Column]:
    """Exon clipped to the coding ends it contains; a pure UTR exon is left whole."""
    coding = abs_start != 0
    return {
        "lim_start": F.when(coding & cds_start.between(start, end), cds_start).otherwise(start),
        "lim_end": F.when(coding & cds_end.between(start, end), cds_end).otherwise(end),
    }


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start <= hi) & (end >= lo)


def strand_position(strand: Column, gene_start: Column, gene_end: Column, position: Column) -> Column:
    """Offset from the 5' end: on the minus strand positions count back from the gene end."""
    return F.when(strand == "-", gene_end - position).otherwise(position - gene_start)


def mirror_interval(strand: Column, gene_end: Column, start: Column, end: Column) -> dict[str, Column]:
    """On the minus strand an interval is read back from the gene end."""
    minus = strand == "-"
    return {
        "view_start": F.when(minus, gene_end - end).otherwise(start),
        "view_end": F.when(minus, gene_end - start).otherwise(end),
    }


def jaccard(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Shared over joint extent of two intervals; 0 when they do not overlap."""
    shared = F.greatest(F.lit(0), F.least(end1, end2) - F.greatest(start1, start2))
    joint = F.greatest(end1, end2) - F.least(start1, start2)
    return F.when(joint > 0, shared.cast("double") / joint.cast("double")).otherwise(F.lit(0.0))
