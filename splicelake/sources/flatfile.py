"""Protein flat files: records, their coding transcript and their regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted record names and texts of the format.
RECORD_PREFIXES = ("NP", "XP")
NO_ACCESSION_NOTE = "propagated from UniProtKB"
FEATURE_BREAK = r"\n     (?=\S)"


def read_protein_flatfile(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: version id, description, length and the feature blocks.

    Records end with ``//`` on its own line, so files split between tasks at
    record ends.
    """
    text = spark.read.option("lineSep", "\n//\n").text(path).withColumn("value", F.concat(F.lit("\n"), "value"))
    record = text.select(
        F.regexp_extract("value", r"\nLOCUS\s+(\S+)", 1).alias("name"),
        F.regexp_extract("value", r"\nLOCUS\s+\S+\s+(\d+) aa", 1).try_cast("bigint").alias("length"),
        F.regexp_extract("value", r"\nVERSION\s+(\S+)", 1).alias("protein_refseq_id"),
        _flat(F.regexp_extract("value", r"(?s)\nDEFINITION  (.*?)\n(?=\S)", 1)).alias("description"),
        F.split(F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*(.*?)\n(?=\S|$)", 1), FEATURE_BREAK).alias("features"),
    )
    kept = record.filter(F.substring("name", 1, 2).isin(*RECORD_PREFIXES))
    return kept.withColumn("description", F.regexp_replace("description", r"\.$", ""))


def _flat(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s*\n\s+", " ")


def _qualifier(block: Column, name: str) -> Column:
    value = F.regexp_extract(block, rf'(?s)/{name}="(.*?)"(?=\n|$)', 1)
    return F.nullif(_flat(value), F.lit(""))


def _first_feature(kind: str) -> Column:
    return F.get(F.filter("features", lambda b: b.rlike(rf"^{kind}\s")), F.lit(0))


def proteins(records: DataFrame) -> DataFrame:
    """Protein table rows with the transcript that codes for each."""
    coded = _qualifier(_first_feature("CDS"), "coded_by")
    transcript = F.regexp_extract(coded, r"(?:join\(|complement\()*([^:()]+):", 1)
    return records.select(
        "protein_refseq_id",
        "description",
        "length",
        _qualifier(_first_feature("Protein"), "note").alias("synonyms"),
        F.nullif(transcript, F.lit("")).alias("transcript_refseq_id"),
    )


def trans2pro(protein_rows: DataFrame) -> DataFrame:
    """(id, other): transcript to protein."""
    return protein_rows.filter("transcript_refseq_id IS NOT NULL").groupBy(
        F.col("transcript_refseq_id").alias("id")
    ).agg(F.max("protein_refseq_id").alias("other"))


def regions(records: DataFrame) -> DataFrame:
    """Region features longer than one residue that carry an accession or a CDD id.

    The accession is the name itself for ``PRK`` entries, else the last ``; ``
    part of the note. A note taken over from UniProtKB names none.
    """
    blocks = records.select("protein_refseq_id", F.explode("features").alias("block")).filter(
        F.col("block").rlike(r"^Region\s")
    )
    location = F.regexp_extract_all(F.regexp_extract("block", r"^Region\s+(\S+)", 1), F.lit(r"(\d+)"), 1)
    r = blocks.select(
        "protein_refseq_id",
        F.element_at(location, 1).try_cast("bigint").alias("aa_start"),
        F.element_at(location, -1).try_cast("bigint").alias("aa_end"),
        _qualifier(F.col("block"), "region_name").alias("name"),
        _qualifier(F.col("block"), "note").alias("raw_note"),
        F.regexp_extract("block", r'/db_xref="CDD:([^"]+)"', 1).alias("cdd"),
    ).filter("name IS NOT NULL AND aa_start <> aa_end")
    parts = F.split("raw_note", "; ")
    listed = F.col("raw_note").contains(";") & ~F.col("raw_note").contains(NO_ACCESSION_NOTE)
    prk = F.col("name").rlike(r"^PRK\d+")
    return r.select(
        "protein_refseq_id",
        "aa_start",
        "aa_end",
        "name",
        F.when(prk, F.col("name")).when(listed, F.element_at(parts, -1)).alias("ext_id"),
        F.nullif(F.col("cdd"), F.lit("")).alias("cdd"),
        F.when(listed & ~prk, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "; "))
        .otherwise(F.col("raw_note"))
        .alias("note"),
    ).filter("ext_id IS NOT NULL OR cdd IS NOT NULL")
