"""Joins and de-duplication on pairs of identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import first_per_key


def or_join(left: DataFrame, right: DataFrame, k1: tuple[str, str], k2: tuple[str, str]) -> DataFrame:
    """Rows equal on the first key or on the second.

    Two equi joins; the second drops pairs the first has found, so no distinct is
    needed. Column names of the sides must differ.
    """
    by_first = left.join(right, F.col(k1[0]) == F.col(k1[1]))
    by_second = left.join(right, F.col(k2[0]) == F.col(k2[1])).filter(
        ~F.coalesce(F.col(k1[0]) == F.col(k1[1]), F.lit(False))
    )
    return by_first.unionByName(by_second)


def semi_join_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def insert_or_ignore(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every complete key; rows with a null in the key are all kept."""
    complete = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return first_per_key(df.filter(complete), keys, order).unionByName(df.filter(f"NOT ({complete})"))


def dedupe_transcripts(
    transcripts: DataFrame,
    order: str,
    refseq: str = "transcript_refseq_id",
    ensembl: str = "transcript_ensembl_id",
) -> DataFrame:
    """Make both ids unique.

    An id already used by an earlier row is cleared; a row left without any id is
    dropped. The earliest user of an id always keeps it, so one minimum per id
    decides every row.
    """
    out = transcripts
    for col, tag in ((refseq, "_r"), (ensembl, "_e")):
        owner = (
            transcripts.filter(F.col(col).isNotNull())
            .groupBy(F.col(col).alias(tag))
            .agg(F.min(order).alias(f"{tag}_owner"))
        )
        out = out.join(owner, F.col(col) == F.col(tag), "left").drop(tag)
    out = out.withColumn(refseq, F.when(F.col(order) == F.col("_r_owner"), F.col(refseq))).withColumn(
        ensembl, F.when(F.col(order) == F.col("_e_owner"), F.col(ensembl))
    )
    return out.drop("_r_owner", "_e_owner").filter(F.coalesce(refseq, ensembl).isNotNull())


def one_gene_row(rows: DataFrame, order: str, geneid: str = "gene_geneid_id", ensembl: str = "gene_ensembl_id") -> DataFrame:
    """Gene rows whose ids were both unseen, taking the first user of each id."""
    out = rows
    for col, tag in ((geneid, "_g"), (ensembl, "_e")):
        owner = (
            rows.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(tag)).agg(F.min(order).alias(f"{tag}_owner"))
        )
        out = out.join(owner, F.col(col) == F.col(tag), "left").drop(tag)
    return out.filter(
        (F.col("_g_owner").isNull() | (F.col("_g_owner") == F.col(order)))
        & (F.col("_e_owner").isNull() | (F.col("_e_owner") == F.col(order)))
    ).drop("_g_owner", "_e_owner")


def newest_version(rows: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """Merge records of one transcript: the newest version's values, older ones fill its nulls."""
    rest = [c for c in rows.columns if c not in (key, version, order)]
    rank = F.struct((-F.col(version)).alias("v"), F.col(order))
    return rows.groupBy(key).agg(
        F.max(version).alias(version),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest],
    )


def ensure_column(df: DataFrame, name: str, ddl_type: str) -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(None).cast(ddl_type))
