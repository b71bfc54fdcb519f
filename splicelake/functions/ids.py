"""Identifier columns: versions, names, domain accessions and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted accession prefixes, the prefix they are stored under,
# and the source table each stored prefix belongs to.
STORED_PREFIX = {
    "cd": "cd",
    "pfam": "pfam",
    "pf": "pfam",
    "smart": "smart",
    "sm": "smart",
    "tigr": "tigr",
    "tigrfams": "tigr",
    "ipr": "IPR",
    "interpro": "IPR",
}
PREFIX_SOURCE = {
    "cd": "cdd",
    "IPR": "interpro",
    "tigr": "tigrfams",
    "pfam": "pfam",
    "smart": "smart",
}
SOURCES = ("cdd", "pfam", "smart", "tigrfams", "interpro")


def literal_map(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def dash_to_null(c: Column) -> Column:
    """The crosswalk writes ``-`` for an absent id."""
    return F.nullif(c, F.lit("-"))


def strip_version(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def version_of(c: Column) -> Column:
    """Text after the first dot; mitochondrial placeholders have the version ``mito``."""
    return F.when(c.startswith("mito"), F.lit("mito")).otherwise(
        F.nullif(F.split_part(c, F.lit("."), F.lit(2)), F.lit(""))
    )


def display_name(refseq: Column, ensembl: Column) -> Column:
    return F.nullif(F.concat_ws(" / ", refseq, ensembl), F.lit(""))


def preferred_id(refseq: Column, ensembl: Column) -> Column:
    return F.coalesce(refseq, ensembl)


def normalize_ext_id(df: DataFrame, ext_id: str = "ext_id", cdd_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into (accepted, rejected).

    Accepted rows get ``ext_norm`` and ``ext_source``. An unknown prefix is
    rejected, and a missing accession is accepted only beside a CDD id.
    """
    raw = F.lower(F.col(ext_id))
    prefix = F.regexp_extract(raw, r"^(.*?)\d*$", 1)
    stored = literal_map(STORED_PREFIX, prefix)
    named = df.withColumn("_stored", stored).withColumn(
        "ext_norm",
        F.when(F.col("_stored").isNotNull(), F.concat("_stored", F.regexp_extract(raw, r"(\d*)$", 1))),
    )
    named = named.withColumn("ext_source", literal_map(PREFIX_SOURCE, F.col("_stored"))).drop("_stored")
    missing_ok = F.col(ext_id).isNull()
    if cdd_id is not None:
        missing_ok = missing_ok & F.col(cdd_id).isNotNull()
    else:
        missing_ok = F.lit(False)
    keep = F.col("ext_norm").isNotNull() | missing_ok
    return named.filter(keep), named.filter(~keep).drop("ext_norm", "ext_source")


# The label and the link of every source, by accession prefix.
SOURCE_LABELS = {"smart": "Smart", "sm": "Smart", "pfam": "Pfam", "pf": "Pfam", "cd": "CDD", "cl": "CDD",
                 "tigr": "Tigr", "ipr": "InterPro"}
SMART_URL = "http://smart.embl-heidelberg.de/smart/do_annotation.pl?DOMAIN="
PFAM_URL = "https://pfam.xfam.org/family/PF"
CDD_URL = "https://www.ncbi.nlm.nih.gov/Structure/cdd/cddsrv.cgi?uid="
TIGR_URL = "http://tigrfams.jcvi.org/cgi-bin/HmmReportPage.cgi?acc="
INTERPRO_URL = "https://www.ebi.ac.uk/interpro/entry/InterPro/"
OTHER_URL = "https://www.ncbi.nlm.nih.gov/Structure/cdd/"
ENSEMBL_URL = "https://www.ensembl.org/"


def _letters(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"^([A-Za-z]*)", 1))


def source_of(source: Column) -> Column:
    """Source label of one accession, compared without case; '' when unknown."""
    return F.coalesce(literal_map(SOURCE_LABELS, _letters(source)), F.lit(""))


def url_for(source: Column) -> Column:
    label = source_of(source)
    number = F.regexp_replace(source, r"^[A-Za-z]+", "")
    is_cd = _letters(source) == "cd"
    return (
        F.when(label == "Smart", F.concat(F.lit(SMART_URL), number))
        .when(label == "Pfam", F.concat(F.lit(PFAM_URL), number))
        .when(is_cd, F.concat(F.lit(CDD_URL), source))
        .when(label == "Tigr", F.concat(F.lit(TIGR_URL), F.upper(source)))
        .when(label == "InterPro", F.concat(F.lit(INTERPRO_URL), source, F.lit("/")))
        .otherwise(F.concat(F.lit(OTHER_URL), source))
    )


def looks_like_id(name: Column) -> Column:
    """A source's prefix and digits alone; CD36 and the like are names."""
    return name.rlike(r"^(?i:smart|pfam|tigr|ipr)[0-9]+$|^cd[0-9]+$")


def ensembl_gene_link(ensembl_name: Column, gene_id: Column) -> Column:
    return F.concat(F.lit(ENSEMBL_URL), ensembl_name, F.lit("/Gene/Summary?db=core;g="), gene_id)


def ensembl_transcript_link(ensembl_name: Column, transcript_id: Column) -> Column:
    return F.concat(F.lit(ENSEMBL_URL), ensembl_name, F.lit("/Transcript/Summary?db=core;t="), transcript_id)


def ensembl_protein_link(ensembl_name: Column, protein_id: Column) -> Column:
    return F.concat(F.lit(ENSEMBL_URL), ensembl_name, F.lit("/Transcript/ProteinSummary?db=core;p="), protein_id)
