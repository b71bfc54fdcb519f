"""UniProt accessions for proteins, last hit per source wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions.ids import strip_version
from splicelake.operators.ordered import first_per_key

STRATEGIES = ("ensembl", "refseq", "ignore")


def mapping_hits(proteins: DataFrame, mapping: DataFrame, *, split_refseq: bool = False) -> DataFrame:
    """Accession of each protein by its RefSeq id and by its Ensembl transcript.

    ``mapping`` has ``ord, accession, refseq_id, enst_id``. A later line overwrites
    an earlier one. An Ensembl transcript is tried as written, then without its
    version, where the first protein to claim the version-less id keeps it.
    ``split_refseq`` takes several ids from one RefSeq cell.
    """
    keyed = proteins.select("protein_key", "protein_refseq_id", "transcript_ensembl_id")
    lines = mapping
    if split_refseq:
        lines = mapping.withColumn("refseq_id", F.explode_outer(F.split("refseq_id", r"; *")))
    by_ref = (
        lines.filter("refseq_id IS NOT NULL AND refseq_id <> ''")
        .groupBy("refseq_id")
        .agg(F.max_by("accession", "ord").alias("refseq_hit"), F.max("ord").alias("last"))
    )
    # Several transcripts may share a protein: one row per protein key.
    refseq = keyed.join(by_ref, F.col("protein_refseq_id") == F.col("refseq_id"))
    refseq = refseq.groupBy("protein_key").agg(F.max_by("refseq_hit", "last").alias("refseq_hit"))

    exact = keyed.filter("transcript_ensembl_id IS NOT NULL").select(
        F.col("transcript_ensembl_id").alias("enst_key"), "protein_key"
    )
    exact = first_per_key(exact, ["enst_key"], ["protein_key"], last=True)
    bare = exact.filter(F.col("enst_key").contains(".")).select(
        strip_version(F.col("enst_key")).alias("enst_key"), "protein_key"
    )
    bare = first_per_key(bare, ["enst_key"], ["protein_key"])
    # An id that is also some protein's full id is never taken as a version-less one.
    bare = bare.join(exact.select("enst_key"), "enst_key", "left_anti")
    claims = exact.unionByName(bare)
    asked = mapping.filter("enst_id IS NOT NULL AND enst_id <> ''").select("ord", "accession", "enst_id")
    as_written = asked.join(claims, F.col("enst_id") == F.col("enst_key"), "left").drop("enst_key")
    missed = as_written.filter("protein_key IS NULL").drop("protein_key").withColumn("_bare", strip_version(F.col("enst_id")))
    hits = as_written.filter("protein_key IS NOT NULL").select("ord", "accession", "protein_key").unionByName(
        missed.join(claims, F.col("_bare") == F.col("enst_key")).select("ord", "accession", "protein_key")
    )
    ensembl = hits.groupBy("protein_key").agg(F.max_by("accession", "ord").alias("ensembl_hit"))
    return refseq.join(ensembl, "protein_key", "full_outer")


def resolve_collision(hits: DataFrame, strategy: str = "ensembl") -> DataFrame:
    """One accession per protein; ``ignore`` leaves disagreeing proteins without one."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    clash = F.col("refseq_hit") != F.col("ensembl_hit")
    chosen = {"ensembl": F.col("ensembl_hit"), "refseq": F.col("refseq_hit"), "ignore": F.lit(None).cast("string")}
    return hits.select(
        "protein_key",
        F.when(clash, chosen[strategy]).otherwise(F.coalesce("refseq_hit", "ensembl_hit")).alias("protein_interpro_id"),
        F.coalesce(clash, F.lit(False)).alias("collision"),
    )


def set_interpro_ids(proteins: DataFrame, mapping: DataFrame, strategy: str = "ensembl") -> DataFrame:
    resolved = resolve_collision(mapping_hits(proteins, mapping), strategy).drop("collision")
    return proteins.join(resolved, "protein_key", "left")
